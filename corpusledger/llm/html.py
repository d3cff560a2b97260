"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed into its element tree. Every element has a binary variable, content or not, with
a potential from its features (tag, words of class and id, text and link shares, place) and one with
its parent's variable, by the kind of tag. Sum-product messages, upward from the leaves and then
downward from the root, give each element's exact marginal. Weights are trained by the exact
gradient of the likelihood of labelled pages, which :mod:`html_pages` makes. An element's own text is
kept when its marginal is at least one half; what is never text (scripts, styles, templates, frames, form controls,
drawings, comments of the markup) is not in the tree.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined by one space in page order. Inline elements join without a space; a line break is a space.

Defined cases: a null page is empty; a page without content gives the empty text. Unclosed elements
end with their parent, stray end tags are ignored, markup that is cut off ends with the page. Quotes count only where the value of an
attribute begins. A form control goes whole, blocks inside it too; one that is never closed ends where a block starts. A label is one of
a control, and goes, if it names or holds one or stands in a form; else it is inline text. A page may be a lone paragraph or plain words.
Repeated rows get equal texts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusledger.llm import html_pages
from corpusledger.llm.common import in_small_batches

#: Their content is raw text: without an end tag they end with the page.
RAW = ("script", "style", "textarea", "iframe", "title")
#: Never text, whatever is in them; without an end tag they end with their parent, or where a block starts.
DROPPED = frozenset("template svg select datalist button option optgroup".split())
#: A new one ends the open one.
ALONE = frozenset("select button option optgroup label".split())
CONTROLS = frozenset("input select textarea button meter progress output".split())
FORMS = ("form", "fieldset")
#: May close themselves.
FOREIGN = ("svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
#: A start tag of the first ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
PARAGRAPH = frozenset({"p"})
#: What is open above them is not closed by a start tag inside.
HOLDS = frozenset("ul ol table div article section main aside body".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote counts only where a value begins; one that is never closed ends with its tag.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
FOR = re.compile(r"(?:^|\s)for\s*=", re.I)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
TAGS = "html body div section article main header footer nav aside form p h1 h2 h3 h4 ul ol li a table tr td blockquote pre figure figcaption dl dd span b".split()
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
NAME_BUCKETS = 256
KINDS = 4


def dropped_until(tokens: list[re.Match]) -> tuple[dict[int, int], set[int]]:
    """Where each dropped element that is closed ends, by the number of its start tag, and the labels that hold a control."""
    ends: dict[int, int] = {}
    labels: set[int] = set()
    around: list[int] = []  # labels on the stack
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()

    def pop() -> tuple[str, int]:
        last = stack.pop()
        opened[last[0]] -= 1
        if last[0] == "label":
            around.pop()
        return last

    for number, m in enumerate(tokens):
        raw = (m[1] or "").lower()
        if raw not in CONTROLS and m[3] is None:
            continue
        tag = raw or m[3].lower()
        if tag in CONTROLS and not m[2] and around:
            labels.add(around[-1])
        if raw or tag in VOID or m[4].endswith("/") and not m[2]:
            continue
        if m[2]:
            if opened[tag]:
                while (last := pop())[0] != tag:
                    pass
                if tag in DROPPED or tag == "label":
                    ends[last[1]] = number
        else:
            if tag in ALONE and opened[tag]:
                while pop()[0] != tag:
                    pass
            if tag == "label":
                around.append(number)
            stack.append((tag, number))
            opened[tag] += 1
    return ends, labels


class Tree:
    """Elements in page order: parent, tag, words of their names, own text pieces by position."""

    __slots__ = ("hidden", "links", "names", "own", "parent", "pieces", "tags")

    def __init__(self, page: str):
        self.parent, self.tags, self.names, self.hidden = [-1], ["#root"], [()], [False]
        self.pieces: list[tuple[int, str]] = []
        self.own, self.links = [0], [0]
        stack, anchors = [0], 0
        opened: Counter[str] = Counter()  # tags on the stack: an end tag without one is known at once
        lost: list[str] = []  # open elements from a dropped one on
        buried: Counter[str] = Counter()  # and their tags

        def cut(depth: int) -> None:
            nonlocal anchors
            for node in stack[depth:]:
                opened[self.tags[node]] -= 1
                anchors -= self.tags[node] == "a"
            del stack[depth:]

        def unbury(tag: str) -> None:
            while (last := lost.pop()) != tag:
                buried[last] -= 1
            buried[tag] -= 1

        tokens = list(TOKEN.finditer(page))
        ends, held = dropped_until(tokens)
        until = -1  # the end tag of the dropped element that is open
        for number, m in enumerate(tokens):
            if number <= until:
                continue
            text = m[5]
            if text is not None:
                if lost:
                    continue
                node = stack[-1]
                size = len(text)
                self.own[node] += size
                if anchors:
                    self.links[node] += size
                self.pieces.append((node, text))
                continue
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            closed = bool(m[4]) and m[4].endswith("/")
            if lost:
                if m[2]:
                    if buried[tag]:
                        unbury(tag)
                        continue
                    if not opened[tag]:
                        continue
                elif tag not in ENDS_P and (tag not in CLOSES or tag == "option") or buried["template"] or buried["foreignobject"]:
                    if tag == "option" == lost[-1]:
                        unbury(tag)
                    if tag not in VOID and not (closed and (tag in FOREIGN or any(buried[x] for x in FOREIGN))):
                        lost.append(tag)
                        buried[tag] += 1
                    continue
                lost.clear()
                buried.clear()
            if m[2]:
                if opened[tag]:
                    cut(next(d for d in range(len(stack) - 1, 0, -1) if self.tags[stack[d]] == tag))
                    if tag not in INLINE:
                        self.pieces.append((stack[-1], " "))
                continue
            if closed and tag in FOREIGN:
                continue
            if tag in DROPPED or tag == "label" and (number in held or any(opened[f] for f in FORMS) or FOR.search(m[4])):
                if number in ends:
                    until = ends[number]
                    continue
                lost.append(tag)
                buried[tag] += 1
                continue
            closes = CLOSES.get(tag, frozenset()) | (PARAGRAPH if tag in ENDS_P else frozenset())
            if any(opened[x] for x in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    up = self.tags[stack[depth]]
                    if up in closes:
                        cut(depth)
                        break
                    if up in HOLDS:
                        break
            if tag not in INLINE:
                self.pieces.append((stack[-1], " "))
            if tag in VOID:
                continue
            attributes = m[4]
            names = ()
            if attributes:
                names = tuple(w for a in NAMES.finditer(attributes) for w in re.split(r"[^a-z]+", (a[1] or a[2] or a[3] or "").lower()) if w)
            self.hidden.append(bool(attributes) and HIDDEN.search(attributes) is not None)
            self.parent.append(stack[-1])
            self.tags.append(tag)
            self.names.append(names)
            self.own.append(0)
            self.links.append(0)
            stack.append(len(self.tags) - 1)
            opened[tag] += 1
            anchors += tag == "a"

    def text(self, keep: np.ndarray) -> str:
        kept = keep.tolist()
        return " ".join(references.unescape("".join(t if kept[n] else " " if not t.strip() else "" for n, t in self.pieces)).split())


@functools.lru_cache(1 << 16)
def _bucket(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % NAME_BUCKETS


#: Indicator features: tag (and other), parent's tag, name buckets, parent's name buckets, then steps of lengths and shares.
_TAG, _UP = 0, len(TAGS) + 1
_NAME = _UP + len(TAGS) + 1
_UPNAME = _NAME + NAME_BUCKETS
_STEP = _UPNAME + NAME_BUCKETS
FEATURES = _STEP + 61
#: A page of nothing else, all of it unnamed, has no structure to tell its main text by.
BARE = INLINE | {"#root", "p", "pre", "div", "section"}


def _kind(tag: str) -> int:
    """Kinds of parent-child potentials: inline, text block, section, other."""
    if tag in INLINE:
        return 0
    return 1 if tag in ("p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "blockquote", "pre", "dd", "dt") else 2 if tag in TAG_NUMBER else 3


def describe(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(node, feature) indicator pairs of a tree."""
    n = len(tree.tags)
    parent = tree.parent
    total, linked, count, blocks = list(tree.own), list(tree.links), [1] * n, [int(t in ("p", "h1", "h2", "h3")) for t in tree.tags]
    depth = [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        linked[p] += linked[i]
        count[p] += count[i]
        blocks[p] += blocks[i]
    whole = max(total[0], 1)
    bare = not any(tree.names) and BARE.issuperset(tree.tags)
    nodes, found, before = [], [], 0
    for i in range(n):
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
        tag = TAG_NUMBER.get(tree.tags[i], len(TAGS))
        up = TAG_NUMBER.get(tree.tags[p], len(TAGS)) if p >= 0 else len(TAGS)
        share, link = total[i] / whole, linked[i] / max(total[i], 1)
        own = [
            tag,
            _UP + up,
            _STEP + min(9, total[i].bit_length()),
            _STEP + 10 + min(9, int(share * 10)),
            _STEP + 20 + min(4, int(link * 5)),
            _STEP + 25 + min(5, blocks[i]),
            _STEP + 31 + min(7, depth[i]),
            _STEP + 39 + min(9, int(before / whole * 10)),
            _STEP + 49 + min(9, tree.own[i].bit_length()),
        ]
        if tree.hidden[i]:
            own.append(_STEP + 59)
        if bare:
            own.append(_STEP + 60)
        own += [_NAME + _bucket(w) for w in set(tree.names[i])]
        if p >= 0:
            own += [_UPNAME + _bucket(w) for w in set(tree.names[p])]
        found += own
        nodes += [i] * len(own)
        before += tree.own[i]
    return np.array(nodes), np.array(found)


class Model:
    """Weights of the content state: one per feature, and a 2 x 2 table per kind of child."""

    def __init__(self):
        self.weights, self.pairs = np.zeros(FEATURES), np.zeros((KINDS, 2, 2))

    def marginals(self, parent, kinds, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and the pairwise marginals of every child with its parent.

        Any number of trees, each root with the parent -1 and parents before children. Messages go up level by level,
        then down.
        """
        parent, kinds = np.asarray(parent, np.int64), np.asarray(kinds, np.int64)
        n = len(parent)
        levels = _levels(parent)
        table = np.exp(self.pairs)[kinds]
        # Weights of both states, kept in proportion: logarithms of messages are summed in the parent.
        log1, log0 = np.clip(unary, -30, 30).astype(float), np.zeros(n)
        up, down, message = np.empty((n, 2)), np.empty((n, 2)), np.ones((n, 2))
        for at in reversed(levels):
            high = np.maximum(log1[at], log0[at])
            up[at, 0], up[at, 1] = np.exp(log0[at] - high), np.exp(log1[at] - high)
            if parent[at[0]] < 0:
                break
            sent = np.einsum("nps,ns->np", table[at], up[at])
            sent /= sent.sum(1, keepdims=True)
            message[at] = sent
            np.add.at(log0, parent[at], np.log(sent[:, 0]))
            np.add.at(log1, parent[at], np.log(sent[:, 1]))
        pair = np.empty((n, 2, 2))
        roots = levels[0]
        down[roots] = up[roots] / up[roots].sum(1, keepdims=True)
        for at in levels[1:]:
            # The parent's belief without this child's message.
            rest = down[parent[at]] / message[at]
            joint = rest[:, :, None] * table[at] * up[at][:, None]
            joint /= joint.sum((1, 2), keepdims=True)
            pair[at] = joint
            belief = np.clip(joint[:, :, 1].sum(1), 1e-12, 1 - 1e-12)
            down[at, 0], down[at, 1] = 1 - belief, belief
        return down[:, 1].copy(), pair

    def keep(self, tree: Tree) -> np.ndarray:
        return self.keep_all([tree])[0]

    def keep_all(self, trees: list[Tree]) -> list[np.ndarray]:
        """The elements of each tree whose text is kept."""
        if not trees:
            return []
        parent, kinds, nodes, found, cuts = _forest([_arrays(t) for t in trees])
        belief, _ = self.marginals(parent, kinds, np.bincount(nodes, self.weights[found], len(parent)))
        return np.split(belief >= 0.5, cuts[1:-1])


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """The nodes of a forest by depth, roots first."""
    depth = [0] * len(parent)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def _arrays(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parents, kinds and indicator pairs of a tree."""
    return np.array(tree.parent), np.array([_kind(t) for t in tree.tags]), *describe(tree)


def _forest(trees: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trees side by side: parent, kinds, nodes, found, and where each begins."""
    cuts = np.r_[0, np.cumsum([len(t[0]) for t in trees])]
    parent = np.concatenate([np.where(t[0] < 0, -1, t[0] + c) for t, c in zip(trees, cuts, strict=False)])
    return parent, np.concatenate([t[1] for t in trees]), np.concatenate([t[2] + c for t, c in zip(trees, cuts, strict=False)]), np.concatenate([t[3] for t in trees]), cuts


def labelled(seed: int) -> tuple[Tree, np.ndarray]:
    """A training page with each element's label: whether most of the text in it is content."""
    open_, close = "\x01", "\x02"
    parts = html_pages.page(seed)
    tree = Tree("".join(re.sub(r"(?<=>)([^<]+)|^([^<]+)", lambda m: (open_ if good else close) + m[0], part) for part, good in parts))
    score = np.zeros(len(tree.tags))
    for node, text in tree.pieces:
        size = len(text.strip(" \x01\x02"))
        score[node] += size if open_ in text else -size
    own = score.copy()
    for i in range(len(score) - 1, 0, -1):
        score[tree.parent[i]] += score[i]
    label = np.where(own != 0, own > 0, score > 0)
    return Tree("".join(part for part, _ in parts)), label


def gradient(model: Model, forest: tuple, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of labelled trees, by weights and by tables."""
    parent, kinds, nodes, found, _ = forest
    belief, pair = model.marginals(parent, kinds, np.bincount(nodes, model.weights[found], len(parent)))
    g = np.bincount(found, (label - belief)[nodes], FEATURES)
    child = np.flatnonzero(parent >= 0)
    pg = np.zeros((KINDS, 2, 2))
    np.add.at(pg, (kinds[child], label[parent[child]], label[child]), 1)
    np.subtract.at(pg, kinds[child], pair[child])
    return g, pg


@functools.lru_cache(4)
def fit(pages: int = 2000, rounds: int = 12, batch: int = 20, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adagrad on the log-likelihood of the labelled pages, ``batch`` of them at a time."""
    model = Model()
    data = []
    for seed in range(pages):
        tree, label = labelled(seed)
        if len(label) == len(tree.tags):
            data.append((*_arrays(tree), label.astype(int)))
    batches = [(_forest(part), np.concatenate([x[4] for x in part])) for part in (data[i : i + batch] for i in range(0, len(data), batch))]
    squares, pair_squares = np.full(FEATURES, 1e-3), np.full((KINDS, 2, 2), 1e-3)
    for _ in range(rounds):
        for forest, label in batches:
            g, pg = gradient(model, forest, label)
            g -= decay * batch * model.weights
            squares += g * g
            model.weights += rate * g / np.sqrt(squares)
            pair_squares += pg * pg
            model.pairs += rate * pg / np.sqrt(pair_squares)
    return model


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = model or fit()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("_html"))
    schema = rows.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 64):
                trees = [Tree(page or "") for page in batch.column(2).slice(at, 64).to_pylist()]
                texts += [tree.text(keep) for tree, keep in zip(trees, model.keep_all(trees), strict=True)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return in_small_batches(rows).mapInArrow(run, schema)
