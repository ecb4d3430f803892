"""Hashes of words and shingles for many texts at a time, as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Bytes of text that are hashed in one step; bounds the memory, not the text.
STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``, which begins with a word or white space and ends with white space."""
    a = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[a]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    up, down = _powers(len(a) + 1)
    sums = np.empty(len(a) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order; A-Z count as a-z. A null text has no words.

    Texts are joined until a step is full; a text beyond a step is cut at white space, its hashes are joined again.
    """
    pack: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        data = b"\n".join(pack) + b"\n"
        starts, hashes = _hash_words(data)
        edges = np.cumsum([0, *[len(p) + 1 for p in pack]])
        cuts = np.searchsorted(starts, edges)
        for i in range(len(pack)):
            yield hashes[cuts[i] : cuts[i + 1]]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(data) > STEP:
            if pack:
                yield from flush()
                pack, held = [], 0
            parts, at = [], 0
            while at < len(data):
                end = at + STEP
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                parts.append(_hash_words(data[at:end] + b"\n")[1])
                at = end
            yield np.concatenate(parts)
            continue
        pack.append(data)
        held += len(data) + 1
        if held >= STEP:
            yield from flush()
            pack, held = [], 0
    if pack:
        yield from flush()


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words as one run if there are fewer; none without words."""
    if not len(words):
        return words
    if len(words) < n:
        n, tag = len(words), U(len(words))
    else:
        tag = U(0)
    out = np.full(len(words) - n + 1, tag, dtype=U)
    for k in range(n):
        out = mix(out * U(0x2545F4914F6CDD1D) + words[k : len(words) - n + 1 + k])
    return np.unique(out)
