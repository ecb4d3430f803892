"""Hashed character n-grams of many texts at a time, as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that are hashed in one step; a longer text is a step of its own.
STEP = 1 << 17


def code_points(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, ends) for runs of texts, lower-cased, with every control or white space code as a space.

    Each text is framed by one space on either side, so that n-grams see the edges of words. A null text is empty.
    """
    pack: list[str] = []
    first = held = 0

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(pack).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        codes[codes <= 32] = 32
        return first, codes, np.cumsum([len(p) for p in pack])

    for n, text in enumerate(texts):
        framed = f" {(text or '').lower()} "
        if pack and held + len(framed) > STEP:
            yield flush()
            pack, held, first = [], 0, n
        pack.append(framed)
        held += len(framed)
    if pack:
        yield flush()


def grams(codes: np.ndarray, low: int, high: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes below 2**bits) of the n-grams that start at each code point, for n from ``low`` to ``high``."""
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, high + 1):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n >= low:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield n, ((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - bits)


def presence(texts: Sequence[str | None], low: int, high: int, bits: int, kept: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each text its distinct n-gram hashes, sorted; only those marked in ``kept`` if it is given."""
    for _, codes, ends in code_points(texts):
        keys, place = [], []
        starts = np.concatenate([[0], ends[:-1]])
        for n, h in grams(codes, low, high, bits):
            at = np.flatnonzero(kept[h]) if kept is not None else np.arange(len(h))
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            keys.append(h[at[inside]].astype(np.int64))
            place.append(doc[inside])
        found = np.unique((np.concatenate(place).astype(np.int64) << bits) | np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        cuts = np.searchsorted(found, np.arange(len(starts) + 1, dtype=np.int64) << bits)
        for i in range(len(starts)):
            yield (found[cuts[i] : cuts[i + 1]] & ((1 << bits) - 1)).astype(np.int32)


def mean_of(texts: Sequence[str | None], low: int, high: int, bits: int, table: np.ndarray) -> np.ndarray:
    """For each text the mean of ``table``'s rows over all its n-grams: a linear function of their frequencies."""
    out = np.zeros((len(texts), table.shape[1]))
    for first, codes, ends in code_points(texts):
        starts = np.concatenate([[0], ends[:-1]])
        total = np.zeros((len(ends), table.shape[1]))
        count = np.zeros(len(ends))
        for n, h in grams(codes, low, high, bits):
            last = np.maximum(ends - n + 1, starts)  # windows that begin before this are inside the text
            for c in range(table.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(table[:, c][h], dtype=np.float64)])
                total[:, c] += sums[np.minimum(last, len(h))] - sums[np.minimum(starts, len(h))]
            count += last - starts
        out[first : first + len(ends)] = total / np.maximum(count, 1)[:, None]
    return out


def frequencies(texts: Sequence[str | None], low: int, high: int, bits: int) -> Iterator[np.ndarray]:
    """For each text the share of every n-gram hash among its n-grams, as a dense row."""
    for _, codes, ends in code_points(texts):
        starts = np.concatenate([[0], ends[:-1]])
        all_grams = list(grams(codes, low, high, bits))
        for a, b in zip(starts, ends, strict=True):
            row = np.zeros(1 << bits, dtype=np.int64)
            for n, h in all_grams:
                row += np.bincount(h[a : max(a, b - n + 1)], minlength=1 << bits)
            yield (row / max(1, row.sum())).astype(np.float32)
