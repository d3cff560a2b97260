"""The words of many texts at once, as 64-bit hashes made by array operations.

A word is a run of anything but ASCII white space. Its hash mixes in its bytes, eight at a time, read as one number, so
that work goes by words and not by bytes; words beyond ``LONG`` bytes are hashed by XXH64 one by one. Work goes window by
window, so that memory beside the text is a few numbers a word.
"""

from __future__ import annotations

import numpy as np

LONG, WINDOW, EIGHT = 64, 1 << 18, 8
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NEWLINE = 10
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray, mult: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * mult
    return x ^ (x >> np.uint64(29))


#: What is left of eight bytes, the first in the lowest bits, of which so many are a word's.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(EIGHT + 1)], np.uint64)


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each word ``buffer[start:end]``. After the last word ``buffer`` has seven bytes more."""
    size = ends - starts
    eights = np.ndarray(max(len(buffer) - EIGHT + 1, 0), "<u8", buffer, strides=(1,))  # those at each byte
    key = np.uint64(np.random.SeedSequence(seed + 0x5EED).generate_state(1, np.uint64)[0])
    out = mix((eights[starts] & HEAD[np.minimum(size, EIGHT)]) ^ (size.astype(np.uint64) * M2 + key), M1)
    at, rest = np.flatnonzero(size > EIGHT), EIGHT
    while len(at):
        # Each step is one to one in the bytes read, whatever came before.
        out[at] = mix((out[at] * M1) ^ (eights[starts[at] + rest] & HEAD[np.minimum(size[at] - rest, EIGHT)]), M2)
        rest += EIGHT
        at = at[(size[at] > rest) & (size[at] <= LONG)]
    out = mix(out * M2, M1)
    if len(long := np.flatnonzero(size > LONG)):
        from xxhash import xxh64_intdigest

        out[long] = [xxh64_intdigest(buffer[a:b].tobytes(), seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


class Words:
    """``hash``, ``line`` of every word of ``texts`` in order; ``document``, ``place`` of every line, which a newline ends."""

    def __init__(self, texts: list[bytes | None], seed: int = 0, lower: bool = False):
        held, lines, kept, many = [], [], [], 0
        some: list[bytes] = []
        size = 0
        for text in [*texts, None]:
            if size > WINDOW or len(kept) == len(texts):
                many += self._scan(some, seed, held, lines, many)
                some, size = [], 0
            if len(kept) == len(texts):
                break
            text = text or b""
            text = text.translate(LOWER) if lower else text
            kept.append(text.count(b"\n") + 1)
            some.append(text)
            size += len(text)
        count = np.array(kept, np.int64)
        self.hash = np.concatenate(held) if held else np.empty(0, np.uint64)
        self.line = np.concatenate(lines) if lines else np.empty(0, np.int64)
        self.document = np.repeat(np.arange(len(texts)), count)
        self.place = np.arange(len(self.document)) - np.repeat(np.cumsum(count) - count, count)

    @staticmethod
    def _scan(texts: list[bytes], seed: int, held: list, lines: list, first: int) -> int:
        """Adds the words of a few texts, whose first line has the number ``first``; the number of their lines."""
        if not texts:
            return 0
        buffer = np.frombuffer(b"\n".join(texts) + b"\n" * EIGHT, np.uint8)
        space = (buffer == 32) | (buffer - np.uint8(9) < 5)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.r_[0, edges]
        starts, ends = edges[0::2], edges[1::2]
        newlines = np.flatnonzero(buffer[: 1 - EIGHT] == NEWLINE)
        held.append(hashes(buffer, starts, ends, seed))
        lines.append(np.repeat(np.arange(first, first + len(newlines)), np.diff(np.searchsorted(starts, newlines), prepend=0)))
        return len(newlines)


def _sorted(line: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sorted by line and number, and which differ from those before. One sort by line and the upper bits of the number; if two different words of a line agree in those, a full one."""
    if len(line) and line.max() < 1 << 20:
        key = (line.astype(np.uint64) << np.uint64(44)) | (number >> np.uint64(20))
        order = np.argsort(key)
        key, sorted_ = key[order], number[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        if (sorted_[same] == sorted_[same + 1]).all():
            fresh = np.ones(len(key), bool)
            fresh[same + 1] = False
            return (key >> np.uint64(44)).astype(np.int64), sorted_, fresh
    order = np.lexsort((number, line))
    line, number = line[order], number[order]
    return line, number, np.r_[True, (line[1:] != line[:-1]) | (number[1:] != number[:-1])][: len(line)]


def by_line(line: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by line and number."""
    return _sorted(line, number)[:2]


def distinct(line: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of each line, sorted by both."""
    line, number, fresh = _sorted(line, number)
    return line[fresh], number[fresh]
