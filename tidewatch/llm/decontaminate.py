"""Benchmark passages in documents: q-gram counts in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import private, row_key, small_side
from tidewatch.session import materialise


@dataclass(frozen=True)
class Settings:
    """A document is hit where some ``window`` characters of an item occur in it with at most ``budget`` edits a character.

    Windows start every ``step`` characters of an item and at its end, so each passage of window + step - 1 unedited
    characters holds a whole one. An item shorter than a window is one window. ``q`` is the length of the q-grams.
    """

    window: int = 72
    step: int = 18
    budget: float = 0.07
    q: int = 8
    #: Characters of benchmark text that are sent to the executors at a time; more items go in several rounds.
    block_chars: int = 500_000
    #: Postings that are held at a time while a text is searched.
    slice_hits: int = 1_000_000


def plain(text: str | None) -> np.ndarray:
    """Code points with white space and control codes as a space and letters in lower case; positions do not change."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(k if len(k := c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[codes <= 32] = 32
    return codes


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """One 64-bit hash for each run of q code points, by doubling."""
    h, n = codes.astype(np.uint64), 1
    out, done = None, 0
    base = 0x9E3779B97F4A7C15
    while True:
        if q & n:
            out = h if out is None else out[: len(h) - done] * np.uint64(pow(base, n, 1 << 64)) + h[done:]
            done += n
        if done == q or len(h) <= n:
            break
        h = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:]
        n *= 2
    if out is None or done < q:
        return np.zeros(0, dtype=np.uint64)
    out = out[: max(0, len(codes) - q + 1)] * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def banded_ends(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best occurrence of ``pattern`` in ``text`` for each place where one can end; beyond ``most`` edits the
    numbers only say that there is none.

    Cells lie on the diagonals of ``text``: column j of row i is text position i + j - most. The start of each path is carried.
    """
    width = len(text) - len(pattern) + 2 * most + 1
    if width <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    big = len(pattern) + len(text) + 1
    j = np.arange(width)
    at = j - most
    ok = (at >= 0) & (at <= len(text))
    cost = np.where(ok, 0, big)
    begin = np.where(ok, at, 0)
    padded = np.concatenate([np.full(most, 0xFFFFFFFF, np.uint32), text, np.full(width + most, 0xFFFFFFFF, np.uint32)])
    for i, c in enumerate(pattern):
        same = cost + (padded[i : i + width] != c)
        drop = np.append(cost[1:] + 1, big)  # a pattern character that the text lacks
        take = drop < same
        best, origin = np.where(take, drop, same), np.where(take, np.append(begin[1:], 0), begin)
        pos = at + i + 1
        best = np.where((pos >= 0) & (pos <= len(text)), best, big)
        run = np.minimum.accumulate(best - j)  # text characters that the pattern lacks
        cost = run + j
        source = np.maximum.accumulate(np.where(best - j == run, j, 0))
        begin = origin[source]
    return cost, begin, at + len(pattern)


def banded_distance(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence of ``pattern`` in ``text``; edits is ``most`` + 1 if there is none."""
    cost, begin, end = banded_ends(pattern, text, most)
    if not len(cost) or cost.min() > most:
        return most + 1, 0, 0
    k = int(cost.argmin())
    return int(cost[k]), int(begin[k]), int(end[k])


def _aligned(text: bytes, pattern: bytes) -> int:
    """First code point of ``text`` where ``pattern`` stands unedited, or -1."""
    at = text.find(pattern)
    while at > 0 and at % 4:
        at = text.find(pattern, at + 1)
    return at // 4 if at >= 0 else -1


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of several (cells, counts) and the sums of their counts."""
    cells, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return cells, np.bincount(place, np.concatenate([p[1] for p in parts]), len(cells)).astype(np.int64)


class Index:
    """All q-grams of the windows of some benchmark items, with what the lemma asks of each window.

    m characters with e edits keep at least m - q + 1 - q * e of their q-grams. The budget of a window is lowered where that
    would not be positive; an item shorter than q characters has no q-gram and cannot be searched.
    """

    def __init__(self, items: Sequence[tuple[int, str]], s: Settings):
        self.settings, self.patterns, self.items, self.offsets = s, [], [], []
        keys, window, place = [], [], []
        need, edits = [], []
        for item, text in items:
            codes = plain(text)
            if len(codes) < s.q:
                continue
            last = max(0, len(codes) - s.window)
            for start in sorted({*range(0, last, s.step), last}):
                p = codes[start : start + s.window]
                e = min(int(s.budget * len(p)), (len(p) - s.q) // s.q)
                h = qgrams(p, s.q)
                keys.append(h)
                window.append(np.full(len(h), len(self.patterns), np.int64))
                place.append(np.arange(len(h)))
                need.append(len(p) - s.q + 1 - s.q * e)
                edits.append(e)
                self.patterns.append(p)
                self.items.append(item)
                self.offsets.append(start)
        self.need, self.edits = np.array(need, np.int64), np.array(edits, np.int64)
        if not keys:
            self.keys = np.zeros(0, np.uint64)
            return
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys = np.concatenate(keys)[order]
        self.window, self.place = np.concatenate(window)[order], np.concatenate(place)[order]
        self.bits = max(16, int(len(self.keys) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True
        self.span = max(len(p) for p in self.patterns) + int(self.edits.max()) - s.q + 1
        self.least = int(self.need.min())

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each window found, in code points of the text."""
        q = self.settings.q
        if not len(self.keys) or text is None or len(text) < q:
            return []
        codes = plain(text)
        h = qgrams(codes, q)
        hit = self.seen[h >> np.uint64(64 - self.bits)]
        # Fewer known q-grams in a stretch than any window needs: nothing to find there.
        sums = np.concatenate([[0], np.cumsum(hit)])
        span = min(self.span, len(h))
        rich = np.flatnonzero(sums[span:] - sums[:-span] >= self.least)
        if not len(rich):
            return []
        near = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(near, rich, 1)
        np.add.at(near, rich + span, -1)
        at = np.flatnonzero(hit & (np.cumsum(near)[:-1] > 0))
        low, high = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        shift = 1 << 40  # bands may be negative
        held: list[tuple[np.ndarray, np.ndarray]] = []
        done = np.concatenate([[0], np.cumsum(high - low)])
        begin = 0
        while begin < len(at):
            # One position has at most as many postings as windows hold its q-gram; so many positions that the slice is about full.
            stop = max(begin + 1, int(np.searchsorted(done, done[begin] + self.settings.slice_hits, "right")) - 1)
            n = (high - low)[begin:stop]
            if not n.any():  # q-grams that only share a place in the table of seen ones
                begin = stop
                continue
            pos = np.repeat(at[begin:stop], n)
            entry = np.repeat(low[begin:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = self.window[entry]
            # Paths of a match within e edits stay within e diagonals, so inside one of two overlapping bands.
            wide = self.edits[window] + 1
            band = (pos - self.place[entry]) // wide
            there = np.zeros(len(self.patterns), bool)
            there[window] = True
            names, low_band = np.flatnonzero(there), int(band.min()) - 1
            bands = int(band.max()) - low_band + 1
            cell = (np.cumsum(there) - 1)[window] * bands + (band - low_band)
            # Each hit counts for its band and the one before. Hits side by side are counted in a table, scattered ones sorted.
            if len(names) * bands <= 4 * self.settings.slice_hits:
                table = np.bincount(cell, minlength=len(names) * bands)
                table[:-1] += table[1:].copy()
                full = np.flatnonzero(table)
                seen = table[full]
            else:
                full, seen = np.unique(np.concatenate([cell, cell - 1]), return_counts=True)
            held.append((names[full // bands] * (2 * shift) + (full % bands + low_band) + shift, seen))
            if sum(len(x[0]) for x in held) > 4 * self.settings.slice_hits:
                held = [_summed(held)]
            begin = stop
        if not held:
            return []
        cells, counts = _summed(held)
        cells = cells[counts >= self.need[cells // (2 * shift)]]
        if not len(cells):
            return []
        found: set[tuple[int, int, int, int]] = set()
        window, band = cells // (2 * shift), cells % (2 * shift) - shift
        # More than a few bands of a window that touch are one region and aligned at once; each reports its best occurrence.
        new = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (band[1:] > band[:-1] + 2)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(cells)], strict=True):
            w = int(window[a])
            e, p = int(self.edits[w]), self.patterns[w]
            if b - a <= 3:
                for own in band[a:b].tolist():
                    first = max(0, own * (e + 1) - e)
                    region = codes[first : (own + 2) * (e + 1) + len(p) + e]
                    k = _aligned(region.tobytes(), p.tobytes())  # an unedited copy needs no alignment
                    edits, start, end = (0, k, k + len(p)) if k >= 0 else banded_distance(p, region, e)
                    if edits <= e:
                        found.add((self.items[w], first + start, first + end, edits))
                continue
            first = max(0, int(band[a]) * (e + 1) - e)
            region = codes[first : (int(band[b - 1]) + 2) * (e + 1) + len(p) + e]
            cost, start, end = banded_ends(p, region, e)
            for own in band[a:b].tolist():
                # Ends that lie in the region of this band alone.
                left = max(0, own * (e + 1) - e) - first
                s = slice(max(0, left), max(0, (own + 2) * (e + 1) + e - first + e + 1))
                if len(cost[s]) and (k := int(cost[s].argmin()) + s.start) < len(cost) and cost[k] <= e:
                    found.add((self.items[w], first + int(start[k]), first + int(end[k]), int(cost[k])))
        return sorted(found)


def _spans(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, edits, windows) of overlapping windows of an item as one passage; edits of its worst window."""
    out: list[list[int]] = []
    for item, start, end, edits in found:
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1][2], out[-1][3], out[-1][4] = max(out[-1][2], end), max(out[-1][3], edits), out[-1][4] + 1
        else:
            out.append([item, start, end, edits, 1])
    return [tuple(x) for x in out]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per passage found: id, item_id, start, end (code points, end exclusive), edits, windows.

    Items of fewer than ``q`` (8) characters cannot be searched and are left out. A passage is found for certain if it holds a whole window, that is from
    window + step - 1 (89) characters on within the budget of edits; of shorter ones those that hold a window or are a whole item.

    Case and the kind of white space do not count, see ``Settings`` for what does. Documents are read whole. Documents and
    items with null or empty text have no passages; a row without id reports a null id; repeated rows
    are reported each, items that repeat id and text once; an empty table on either side gives an empty result; other columns are ignored.

    The benchmark is a query set: it is sent to the executors in blocks of about ``block_chars`` characters (more only where one item is
    longer), one scan of the documents for each, and the documents are never shuffled. Long and repetitive
    texts (runs of one character) are read in slices of ``slice_hits`` postings, and touching bands are aligned once.
    """
    s = settings or Settings()
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("body")).filter("length(body) > 0").distinct()
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = 1 + total // s.block_chars
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"{id_col} long, {item_col} long, start long, end long, edits int, windows int"
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block).orderBy("item", "body").collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in own], s))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                ids = batch.column("id").to_pylist()
                for k, text in enumerate(batch.column("text")):
                    rows += [(ids[k], *x) for x in _spans(index.value.search(text.as_py()))]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, item_col, "start", "end", "edits", "windows"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a passage. A row without id is told by its text, so it goes, too, if its text holds one.

    All columns are kept as they are; null and empty texts hold no passage, rows that repeat an id go with it.
    """
    found = find_passages(docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, settings)
    (gone,) = private(docs, "gone")
    hit = materialise(found.select(F.col("doc_id").alias(gone)).distinct(), "contaminated")
    return docs.join(small_side(hit), row_key(id_col, text_col) == F.col(gone), "left_anti")
