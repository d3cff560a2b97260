"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WIDTH``; the last window ends with the text, so it may
overlap the one before, and each byte is counted once. In every window one GRU reads left to right
and one right to left, and a softmax over both states labels every position. The document's
probabilities are the mean over all its positions. Input weights are one table row per byte value.
The network is trained in numpy by backpropagation through time (Adam) on windows of at most
``per_language`` labelled documents a language, at most ``windows`` windows each, spread evenly over
the whole text. Windows of many documents run in lockstep, one matrix product a position.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text
when there is nothing to learn from. Rows with a null language are never learnt from. Repeated rows
get equal predictions. Texts shorter than a window are padded with spaces that are not counted. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusledger.llm.common import in_small_batches
from corpusledger.runtime import materialise

WIDTH = 64
HIDDEN = 8
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Network:
    """A GRU a direction: z and r gates and a candidate, the reset applied after the recurrent product.

    States are kept features by windows, so each gate is a block of rows. Gate rows of the tables and
    recurrent weights are halved when running, as the logistic function is made from tanh.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.params = {
            "out": draw.normal(0, 0.3, (len(labels), 2 * hidden)),
            "bias": np.zeros((len(labels), 1)),
        }
        for way in "fb":
            self.params[f"in_{way}"] = draw.normal(0, 0.3, (3 * hidden, 256))
            self.params[f"rec_{way}"] = draw.normal(0, 0.3, (3 * hidden, hidden))
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _steps(self, width: int, way: str) -> range:
        return range(width) if way == "f" else range(width - 1, -1, -1)

    def _read(self, data: np.ndarray, way: str) -> np.ndarray:
        """States after each position: (width, hidden, windows)."""
        n, width = data.shape
        hid = self.hidden
        halve = np.r_[np.full(2 * hid, 0.5), np.ones(hid)].astype(np.float32)[:, None]
        table, rec = np.ascontiguousarray(self.params[f"in_{way}"] * halve), np.ascontiguousarray(self.params[f"rec_{way}"] * halve)
        states, h = np.empty((width, hid, n), np.float32), np.zeros((hid, n), np.float32)
        x, g, by = np.empty((3 * hid, n), np.float32), np.empty((3 * hid, n), np.float32), np.ascontiguousarray(data.T).astype(np.intp)
        for t in self._steps(width, way):
            np.take(table, by[t], axis=1, out=x, mode="clip")
            np.matmul(rec, h, out=g)
            gates = x[: 2 * hid]
            gates += g[: 2 * hid]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            cand = g[2 * hid :]
            cand *= gates[hid:]
            cand += x[2 * hid :]
            np.tanh(cand, out=cand)
            h -= cand
            h *= gates[:hid]
            h += cand
            states[t] = h
        return states

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of every position: (width, labels, windows)."""
        out = np.matmul(self.params["out"][:, : self.hidden], self._read(data, "f"))
        out += np.matmul(self.params["out"][:, self.hidden :], self._read(data, "b"))
        out += self.params["bias"]
        np.clip(out, -30, 30, out=out)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def gradient(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradient, by backpropagation through time."""
        n, width = data.shape
        hid, p = self.hidden, self.params
        ways = {way: self._read(data, way) for way in "fb"}
        both = np.concatenate([ways["f"], ways["b"]], axis=1)
        logits = np.matmul(p["out"], both) + p["bias"]
        logits -= logits.max(1, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(1, keepdims=True)
        at = np.arange(n)
        loss = -float(np.log(probs[:, target, at] + 1e-9).mean())
        probs[:, target, at] -= 1
        probs /= n * width
        grad = {"out": np.einsum("tln,thn->lh", probs, both), "bias": probs.sum((0, 2))[:, None]}
        back = np.matmul(p["out"].T, probs)
        for k, way in enumerate("fb"):
            table, rec, states = p[f"in_{way}"], p[f"rec_{way}"], ways[way]
            d_table, d_rec = np.zeros_like(table), np.zeros_like(rec)
            order, dh = list(self._steps(width, way)), np.zeros((hid, n), np.float32)
            for i in range(width - 1, -1, -1):
                t = order[i]
                h = states[order[i - 1]] if i else np.zeros((hid, n), np.float32)
                x, g = table[:, data[:, t]], rec @ h
                z = 1 / (1 + np.exp(-(x[:hid] + g[:hid])))
                r = 1 / (1 + np.exp(-(x[hid : 2 * hid] + g[hid : 2 * hid])))
                c = np.tanh(x[2 * hid :] + r * g[2 * hid :])
                dh = dh + back[t, k * hid : (k + 1) * hid]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * g[2 * hid :] * r * (1 - r)
                dx, dg = np.concatenate([dz, dr, dc]), np.concatenate([dz, dr, dc * r])
                d_rec += dg @ h.T
                for row in range(3 * hid):
                    d_table[row] += np.bincount(data[:, t], dx[row], 256)
                dh = dh * z + rec.T @ dg
            grad[f"in_{way}"], grad[f"rec_{way}"] = d_table, d_rec
        return loss, grad

    def fit(self, data: np.ndarray, target: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 0) -> float:
        draw, loss = np.random.default_rng(seed), 0.0
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        groups = [np.flatnonzero(target == k) for k in range(len(self.labels))]
        for step in range(1, steps + 1):
            rows = np.concatenate([draw.choice(g, max(1, batch // len(groups))) for g in groups])
            loss, grad = self.gradient(data[rows], target[rows])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in self.params.items():
                g = np.clip(grad[k], -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                v -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def cut(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The windows of a text and how many first bytes of its last window are not counted.

    A text shorter than a window is padded on the left.
    """
    body = np.frombuffer(text, np.uint8)
    if len(body) <= width:
        return np.concatenate([np.full(width - len(body), 32, np.uint8), body])[None], width - len(body)
    whole = len(body) // width
    rows, rest = body[: whole * width].reshape(-1, width), len(body) % width
    if not rest:
        return rows, 0
    return np.concatenate([rows, body[-width:][None]]), width - rest


def classify(net: Network, texts: list[str | None], lockstep: int = 4096) -> list[tuple[str, float]]:
    """(label, score) per text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    waiting, held = [], 0

    def settle() -> None:
        nonlocal held
        data = np.concatenate([w for _, w, _ in waiting])
        sums = np.empty((len(net.labels), len(data)))
        lasts, skips = np.cumsum([len(w) for _, w, _ in waiting]) - 1, [s for _, _, s in waiting]
        for at in range(0, len(data), lockstep):
            probs = net.positions(data[at : at + lockstep])
            sums[:, at : at + lockstep] = probs.sum(0)
            for last, skip in zip(lasts, skips, strict=True):
                if skip and at <= last < at + lockstep:
                    sums[:, last] -= probs[:skip, :, last - at].sum(0)
        totals = np.add.reduceat(sums, np.r_[0, lasts[:-1] + 1], axis=1)
        totals /= totals.sum(0)
        for (i, _, _), best, score in zip(waiting, totals.argmax(0), totals.max(0), strict=True):
            out[i] = (net.labels[best], float(score))
        waiting.clear()
        held = 0

    for i, text in enumerate(texts):
        if text and LETTER.search(text):
            windows, skip = cut(text.encode("utf-8", "replace"))
            waiting.append((i, windows, skip))
            held += len(windows)
            if held >= lockstep:
                settle()
    if waiting:
        settle()
    return out


def training_windows(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int, windows: int, sample: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, windows and targets of a sample of every language: ``per_language`` documents each, fewer where that makes more than ``sample`` in all."""
    known = in_small_batches(docs).filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # A language is a row here and a column of the network: ``sample`` of them at most.
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return [], np.empty((0, WIDTH), np.uint8), np.empty(0, np.int64)
    per_language = max(1, min(per_language, sample // len(counts)))
    # A hash slice of about four times the sample first: no task ranks all rows of a language, and only the slice's texts are shuffled.
    row = F.xxhash64("doc_id", "text")
    shares = docs.sparkSession.createDataFrame([(r[0], min(1.0, 4 * per_language / r[1])) for r in counts], "_lang string, _share double")
    sliced = F.pmod(F.xxhash64("doc_id", "text", F.lit("slice")), F.lit(1 << 30)) / (1 << 30) < F.col("_share")
    met = known.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(sliced).select("lang", "text", row.alias("row"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("row", "text"))
    picked = materialise(met.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("lang", "text"), "language-sample")
    # A language whose few different rows all miss the slice is learnt from the first of them.
    found = {r[0] for r in picked.select("lang").distinct().collect()}
    missed = [r[0] for r in counts if r[0] not in found]
    if missed:
        picked = picked.unionByName(known.filter(F.col("lang").isin(missed)).groupBy("lang").agg(F.min_by("text", row).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    found = cut(text.encode("utf-8", "replace"))[0]
                    for k in sorted(set(np.linspace(0, len(found) - 1, windows).astype(int).tolist())):
                        langs.append(lang)
                        parts.append(found[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    rows = picked.select("lang", "text").mapInArrow(run, "lang string, part binary").orderBy("lang", "part").collect()
    labels = sorted({r[0] for r in rows})
    data = np.array([np.frombuffer(r[1], np.uint8) for r in rows], np.uint8).reshape(-1, WIDTH)
    return labels, data, np.array([labels.index(r[0]) for r in rows], np.int64)


def train(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, windows: int = 24, steps: int = 300, sample: int = 20_000
) -> Network | None:
    labels, data, target = training_windows(docs, learn, id_col, text_col, lang_col, per_language, windows, sample)
    if not labels:
        return None
    net = Network(labels)
    net.fit(data, target, steps)
    return net


def predict(rows: DataFrame, net: Network | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), drop_text: bool = False) -> DataFrame:
    """All rows and columns with the two predictions added under ``names``."""
    kept = [c for c in rows.columns if not (drop_text and c == text_col)]
    if net is None:
        return rows.select(*kept, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    at_text, order = rows.columns.index(text_col), [rows.columns.index(c) for c in kept]
    schema = rows.select(*kept).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 512):
                found += classify(net, batch.column(at_text).slice(at, 512).to_pylist())
            labels, scores = zip(*found, strict=True) if found else ((), ())
            columns = [*(batch.column(i) for i in order), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return in_small_batches(rows).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the documents outside the held-out fold."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))
    net = train(docs, ~out, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return predict(rows, net, "_text", drop_text=True)
