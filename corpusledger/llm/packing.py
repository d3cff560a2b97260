"""Sum-of-squares packing of tokenised documents into windows.

Each task packs the rows of its own input partition as they stream by, so nothing is shuffled and
an executor that is lost costs only its tasks. A document longer than a window is cut into full
windows; its rest is placed whole at the fill level that makes the sum of the squared counts of
partially filled windows smallest. The counts live in a level array, the open windows in one stack
a level. When a partition ends, or more than ``max_open`` windows are open, the open windows are
settled: the emptiest are cut to fill the fullest, and the last one is cut into windows whose fills
are powers of two. No sequence then needs padding.

Defined cases: a null text is the empty document, which is the end token alone. Rows that repeat are
packed each for itself. Rows with a null id are packed, with a null id. An empty table gives no
pieces. Further input columns are ignored. Texts of any length are packed whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusledger.llm.common import in_small_batches, kept

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, fill long"


#: A full stop or comma after a letter or digit and before white space is a token of its own.
_END = re.compile(rb"([.,])(?:(?<=[a-z0-9].)|(?<=\xc3[\xa0-\xb6\xb8-\xbf].))(?=[ \t\n\x0b\f\r])")


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases and never joins characters across ASCII white space, nor letters with
    what is no letter, so each run between white space is encoded once and remembered; ``memory``
    bounds how many are kept, none beyond 32 bytes: a Python worker holds them for its later tasks too. Unknown runs of lower-case letters are encoded in one call, past the
    normaliser and the splitting pattern, which leave them as they are; each ends with the only token
    of it that is marked as an end of word.
    """

    def __init__(self, path: str, memory: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memory, self.known = Tokenizer.from_file(path), memory, {}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker, kept from task to task."""
        return kept(f"packing {path}", lambda: cls(path))

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        made: dict[bytes, bytes] = {}
        letters, others = [], []
        for word in words:
            text = word.decode("utf-8", "replace")
            plain = text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)
            (letters if plain else others).append(word)
        for at in range(0, len(letters), 20_000):
            part = letters[at : at + 20_000]
            ids = np.asarray(self.bare.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                others += part
                continue
            body, cuts = ids.tobytes(), (4 * cuts).tolist()
            made.update((word, body[i:j]) for word, i, j in zip(part, [0, *cuts], cuts, strict=False))
        found = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace") for word in others], add_special_tokens=False) if others else []
        made.update((word, np.asarray(x.ids, "<u4").tobytes()) for word, x in zip(others, found, strict=True))
        return made

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        rows = [(text if b"<|" in text else _END.sub(rb" \1", text.lower())).split() for text in texts]
        found = [list(map(self.known.get, row)) for row in rows]
        fresh = {word for row, ids in zip(rows, found, strict=True) if None in ids for word, x in zip(row, ids, strict=True) if x is None}
        made = self._encode(list(fresh)) if fresh else {}
        for row, ids in zip(rows, found, strict=True):
            if None in ids:
                ids = [made[word] if x is None else x for word, x in zip(row, ids, strict=True)]
            yield b"".join(ids)
        if len(self.known) + len(made) <= self.memory:
            self.known.update((word, ids) for word, ids in made.items() if len(word) <= 32)


class SumOfSquares:
    """The online packer of one partition. Pieces are (tag, start, ids); emitted with window and offset."""

    def __init__(self, capacity: int, emit: Callable[[int, list], None], max_open: int = 4096):
        self.capacity, self.emit, self.max_open = capacity, emit, max_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def add(self, tag, ids: bytes) -> None:
        cap, n = self.capacity, len(ids) // 4
        for at in range(0, n - n % cap, cap):
            self.emit(cap, [(tag, at, ids[4 * at : 4 * (at + cap)])])
        if rest := n % cap:
            self.place((tag, n - rest, ids[4 * (n - rest) :]), rest)

    def choose(self, size: int) -> int:
        """The level to place ``size`` at: least change of the sum of squares, then the fullest."""
        cap, levels = self.capacity, self.levels
        best, change = 0, 2 * levels[size] + 1
        if cap - size >= 1:
            before, after = levels[1 : cap - size + 1], levels[size + 1 : cap + 1]
            delta = 2 * (after - before) + 2
            delta[-1] = 1 - 2 * before[-1]
            delta = np.where(before > 0, delta, np.iinfo(np.int64).max)[::-1]
            k = int(delta.argmin())
            if delta[k] <= change and delta[k] != np.iinfo(np.int64).max:
                best = cap - size - k
        return best

    def place(self, piece: tuple, size: int) -> None:
        level = self.choose(size)
        window = self.stacks[level].pop() if level else []
        window.append(piece)
        if level:
            self.levels[level] -= 1
            self.open -= 1
        if level + size == self.capacity:
            self.emit(self.capacity, window)
            return
        self.levels[level + size] += 1
        self.stacks[level + size].append(window)
        self.open += 1
        if self.open > self.max_open:
            self.settle()

    def settle(self) -> None:
        """Close all open windows with no padding: fill the fullest from the emptiest, cutting."""
        cap = self.capacity
        left = [(level, window) for level in range(cap, 0, -1) for window in self.stacks[level]]
        head, tail = 0, len(left) - 1
        while head < tail:
            gap, window = cap - left[head][0], left[head][1]
            while gap and head < tail:
                level, donor = left[tail]
                tag, start, ids = donor.pop()
                size = len(ids) // 4
                if size > gap:
                    donor.append((tag, start, ids[: 4 * (size - gap)]))
                    start, ids, size = start + size - gap, ids[4 * (size - gap) :], gap
                window.append((tag, start, ids))
                gap -= size
                left[tail] = (level - size, donor)
                tail -= not donor
            left[head] = (cap - gap, window)
            if not gap:
                self.emit(cap, window)
                head += 1
        if head == tail:
            self._powers(*left[head])
        self.levels[:] = 0
        self.stacks = [[] for _ in range(cap + 1)]
        self.open = 0

    def _powers(self, level: int, window: list) -> None:
        while level:
            fill = 1 << (level.bit_length() - 1)
            part, room = [], fill
            while room:
                tag, start, ids = window.pop(0)
                size = len(ids) // 4
                if size > room:
                    window.insert(0, (tag, start + room, ids[4 * room :]))
                    ids, size = ids[: 4 * room], room
                part.append((tag, start, ids))
                room -= size
            self.emit(fill, part)
            level -= fill


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each lies at.

    ``with_ids`` adds the ids themselves, an array of int. ``fill`` is the sequence's length.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer_path)
        base, made, out = TaskContext.get().partitionId() << 36, 0, []

        def emit(fill: int, pieces: list) -> None:
            nonlocal made
            offset = 0
            for (doc_id, total), start, ids in pieces:
                n = len(ids) // 4
                row = (doc_id, start, n, zlib.crc32(ids), total, base + made, offset, fill)
                out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
                offset += n
            made += 1

        def drain() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[8:]]
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        packer = SumOfSquares(window, emit, max_open)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [x or b"" for x in texts.slice(at, 256).to_pylist()]
                for doc_id, body in zip(ids[at : at + 256], encode(part), strict=True):
                    body += end
                    packer.add((doc_id, len(body) // 4), body)
            if out:
                yield drain()
        packer.settle()
        if out:
            yield drain()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return in_small_batches(rows).mapInArrow(run, schema)
