"""Labelled pages that the HTML model is trained on: made by rule from a seed, none taken from a corpus.

Each page is a list of (piece of markup, is its text content). Layouts, tag choices, class names and text
lengths vary; many pages use no semantic tags, some are cut off or leave tags open.
"""

from __future__ import annotations

import random

CONTENT_NAMES = ["article", "post", "entry-content", "main", "content", "story", "article-body", "post-text", "text", "body-copy"]
CHROME = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "topnav", "links", "tabs", "pager"],
    "header": ["header", "masthead", "site-header", "banner", "logo", "topbar"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "colophon", "legal"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending", "more-stories", "share", "social", "tags", "author-box"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement", "ad-slot"],
    "notice": ["cookie", "cookie-banner", "notice", "alert", "consent", "gdpr", "popup", "newsletter", "paywall", "modal"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "disqus", "reader-comments", "responses"],
    "form": ["search", "login", "subscribe", "signup", "contact-form"],
}
#: One page in so many has no structure.
PLAIN_EVERY = 16
SYLLABLES = "an ber con de el fi ga hu in jo ka lo mi no or pa que ra si to ur va wi xe yo zu th er on st re".split()


def _words(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
    out = " ".join(words).capitalize()
    return out + r.choice([".", ".", ".", "", "!", "?"]) if high > 6 else out


def _sentences(r: random.Random) -> str:
    return " ".join(_words(r, 4, 18) for _ in range(r.choice([1, 1, 2, 3, 5, 9])))


def _inline(r: random.Random, text: str) -> str:
    words = text.split(" ")
    for _ in range(r.choice([0, 0, 1, 2])):
        i = r.randrange(len(words))
        tag = r.choice(["b", "em", "strong", "i", "a", "span", "code"])
        words[i] = f"<{tag}{' href=#' if tag == 'a' else ''}>{words[i]}</{tag}>"
    return " ".join(words)


def _named(r: random.Random, names: list[str], p: float = 0.9) -> str:
    if r.random() > p:
        return ""
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-" + r.choice(SYLLABLES), " " + r.choice(SYLLABLES)])}"'


def _chrome(r: random.Random, kind: str) -> list[tuple[str, bool]]:
    semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
    tag = semantic if r.random() < 0.6 else r.choice(["div", "div", "section"])
    name = _named(r, CHROME[kind], 0.5 if tag not in ("div", "section") else 1.0)
    out = [(f"<{tag}{name}>", False)]
    if kind == "nav" or (kind in ("aside", "footer", "header") and r.random() < 0.5):
        items = "".join(f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' for i in range(r.randint(2, 9)))
        out.append((r.choice([f"<ul>{items}</ul>", items.replace("<li>", " ").replace("</li>", " | ")]), False))
    elif kind == "form":
        out.append((f"<label>{_words(r, 1, 3)}</label><input name=q><select><option>{_words(r, 1, 2)}</select><button>{_words(r, 1, 2)}</button>", False))
    elif kind == "comments":
        out.append((f"<h3>{_words(r, 1, 3)}</h3>", False))
        for _ in range(r.randint(1, 5)):
            inner = r.choice(["p", "div", "span"])
            out.append((f'<{r.choice(["li", "div", "article"])}{_named(r, CHROME["comments"])}><b>{_words(r, 1, 2)}</b> <{inner}>{_sentences(r)}</{inner}>', False))
    else:
        for _ in range(r.randint(1, 3)):
            inner = r.choice(["p", "div", "span", "a", ""])
            text = r.choice([_words(r, 2, 12), _sentences(r), f"&copy; {_words(r, 1, 4)} &middot; {_words(r, 2, 6)}"])
            out.append((f"<{inner}>{text}</{inner}>" if inner else text, False))
    out.append((f"</{tag}>", False))
    return out


def _article(r: random.Random) -> list[tuple[str, bool]]:
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section", None])
    name = _named(r, CONTENT_NAMES, 0.3 if tag in ("article", "main") else 0.8)
    out: list[tuple[str, bool]] = [(f"<{tag}{name}>", True)] if tag else []
    if r.random() < 0.85 or not out:
        out.append((f"<h1>{_words(r, 2, 12)}</h1>", True))
    for _ in range(r.choice([0, 1, 1, 2, 4, 8, 14])):
        kind = r.choices(["p", "open", "h2", "list", "quote", "table", "bare", "pre", "short"], [10, 2, 2, 1, 1, 0.5, 1, 0.5, 2])[0]
        text = _inline(r, _sentences(r))
        if kind == "p":
            out.append((f"<p>{text}</p>", True))
        elif kind == "short":
            out.append((f"<p>{_words(r, 1, 3)}.</p>", True))
        elif kind == "open":
            out.append((r.choice([f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}<br>{_words(r, 3, 9)}"]), True))
        elif kind == "h2":
            level = r.randint(2, 4)
            out.append((f"<h{level}>{_words(r, 2, 8)}</h{level}>", True))
        elif kind == "list":
            out.append(("<ul>" + "".join(f"<li>{_words(r, 3, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", True))
        elif kind == "quote":
            out.append((f"<blockquote><p>{text}</p></blockquote>", True))
        elif kind == "table":
            out.append(("<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 6)}</td></tr>" for _ in range(3)) + "</table>", True))
        elif kind == "pre":
            out.append((f"<pre>{_words(r, 4, 12)}\n {_words(r, 3, 9)}</pre>", True))
        else:
            out.append((r.choice([text, f"<div>{text}</div>"]), True))
        if r.random() < 0.06:
            out += _chrome(r, r.choice(["ad", "aside", "notice", "form"]))
    if tag:
        out.append((f"</{tag}>", True))
    return out


def _plain(r: random.Random) -> list[tuple[str, bool]]:
    """A fragment without structure: words, or a few paragraphs, and nothing around them."""
    if r.random() < 0.4:
        return [(_inline(r, _sentences(r)), True)]
    tag = r.choice(["p", "p", "p", "div", "span", "pre", "section"])
    return [(f"<{tag}>{_inline(r, _sentences(r))}{r.choice(['', f'</{tag}>'])}", True) for _ in range(r.choice([1, 1, 1, 2, 4]))]


def page(seed: int) -> list[tuple[str, bool]]:
    r = random.Random(seed)
    if seed % PLAIN_EVERY == PLAIN_EVERY - 1:
        return _plain(r)
    script = f"<script>var t=\"</p>\";f({_words(r, 2, 5)!r})</script>"
    out = [(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_words(r, 2, 8)}</title><style>p{{margin:0}}</style>{script}</head><body>", False)]
    before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.45]
    after = [k for k in ("comments", "aside", "ad", "nav", "form", "notice", "footer") if r.random() < 0.45]
    wrap = r.random() < 0.3
    if wrap:
        out.append((f"<div{_named(r, ['wrapper', 'page', 'container', 'site', 'layout'])}>", False))
    for kind in before:
        out += _chrome(r, kind)
    out += _article(r)
    for kind in after:
        out += _chrome(r, kind)
    if wrap:
        out.append(("</div>", False))
    if r.random() < 0.8:
        out.append(("</body></html>", False))
    return out
