"""Spelling variants: words one edit apart, found by a dynamic programme over sorted lists, and the form each goes back to."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_side
from tidewatch.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a group that are scanned against each other in one cell; code points that a batch of cells and rows that a step may hold.
BLOCK, BATCH, STEP = 8192, 1 << 19, 1 << 20
FOUND = "side int, line string, near long, best_n long, best string"


def _matrix(words: list[str], cut: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words without their first ``cut``, filled up with ``pad``, and the lengths that are left."""
    size = np.fromiter(map(len, words), np.int64, len(words)) - cut
    out = np.full((len(words), int(size.max(initial=0)) + 1), pad, dtype=np.int32)
    points = np.frombuffer("".join(w[c:] for w, c in zip(words, cut.tolist(), strict=True)).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = points
    return out, size


def near_in_lists(
    words: list[str], group: np.ndarray, cut: np.ndarray, askers: list[str] | None = None, asker_group: np.ndarray | None = None, asker_cut: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of asker, index of word) of one group that are exactly one edit apart.

    ``words`` are sorted lists, one after the other (``group``: number of the list, rising); the words of a list agree in their first
    ``cut`` code points, and so do its askers (all words, if none are given). A range of a list whose adjacent common prefixes
    reach down to depth d stands for one prefix of d letters: for each asker the edit matrix has one row for it, of
    which the three cells around the diagonal are kept. The row is computed once and reused by all words of the range; when all its
    cells exceed one edit, the range is skipped. The scan goes one letter deeper in each step, for all askers and ranges together,
    in pieces of at most ``STEP`` rows.
    """
    r, size = _matrix(words, cut, -1)
    if askers is None:
        q, asked, asker_group = np.where(r < 0, -2, r), size, group
    else:
        q, asked = _matrix(askers, asker_cut, -2)
    q = np.pad(q, ((0, 0), (1, 3)), constant_values=-2)
    deep = int(size.max(initial=0))
    same = np.cumprod(r[1:] == r[:-1], axis=1, dtype=np.int8).sum(axis=1) if len(words) > 1 else np.zeros(0, np.int64)
    lcp = np.concatenate([[-1], np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), -1)])

    def ranges(d: int) -> np.ndarray:
        """First word of each range of words that agree in d letters."""
        return np.flatnonzero((lcp < d) & (size >= d))

    starts = [ranges(0)]
    at = np.searchsorted(group[starts[0]], asker_group)
    known = (at < len(starts[0])) & (group[starts[0]][np.minimum(at, len(starts[0]) - 1)] == asker_group)
    node, asker = at[known], np.flatnonzero(known)
    row = np.tile(np.array([2, 0, 1], np.int8), (len(asker), 1))
    row[asked[asker] < 1, 2] = 2
    left, right = [], []
    work = [(0, node, asker, row)]
    children: list[tuple[np.ndarray, np.ndarray]] = []
    while work:
        d, node, asker, row = work.pop()
        first = starts[d][node]
        ends = np.flatnonzero((size[first] == d) & (np.abs(asked[asker] - d) <= 1))
        if len(ends):
            hit = ends[row[ends, asked[asker[ends]] - d + 1] == 1]
            left.append(asker[hit])
            right.append(first[hit])
        if d == deep:
            continue
        if len(starts) == d + 1:
            starts.append(ranges(d + 1))
            parent = np.searchsorted(starts[d], starts[d + 1], "right") - 1
            edges = np.searchsorted(parent, np.arange(len(starts[d]) + 1))
            children.append((edges[:-1], edges[1:]))
        low, high = children[d][0][node], children[d][1][node]
        many = high - low
        total = np.cumsum(many)
        if len(total) and total[-1] > STEP and len(node) > 1:
            half = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(node) - 1)
            work += [(d, node[s], asker[s], row[s]) for s in (slice(half), slice(half, None))]
            continue
        up = np.repeat(np.arange(len(node)), many)
        if not len(up):
            continue
        child = np.arange(len(up)) - np.repeat(total - many, many) + np.repeat(low, many)
        who, old = asker[up], row[up]
        letter, ahead = r[starts[d + 1][child], d], asked[who] - d
        new = np.empty_like(old)
        new[:, 0] = np.minimum(old[:, 1] + 1, old[:, 0] + (q[who, d] != letter))
        new[:, 1] = np.minimum(np.minimum(old[:, 2] + 1, old[:, 1] + (q[who, d + 1] != letter)), new[:, 0] + 1)
        new[ahead < 1, 1] = 2
        new[:, 2] = np.minimum(old[:, 2] + (q[who, d + 2] != letter), new[:, 1] + 1)
        new[ahead < 2, 2] = 2
        live = np.flatnonzero((new.min(axis=1) <= 1) & (ahead >= 0))
        if len(live):
            work.append((d + 1, child[live], who[live], new[live]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (side, m, part, i, j, block, line, n) sorted by all of them, to what each word has found in its cell."""

    def cells(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        side, m, i, j, block, n = (t.column(c).to_numpy() for c in ("side", "m", "i", "j", "block", "n"))
        line = np.array(t.column("line").to_pylist(), dtype=object)
        half = m // 2
        cut = np.where(side == 0, half, m - half).astype(np.int64)
        same, listed, asks = i == j, block == i, block == j
        pairs = []
        for rows, askers in ((np.flatnonzero(same), None), (np.flatnonzero(~same & listed), np.flatnonzero(~same & asks))):
            if len(rows) < (2 if askers is None else 1) or (askers is not None and not len(askers)):
                continue
            more = () if askers is None else (line[askers].tolist(), number[askers], cut[askers])
            a, b = near_in_lists(line[rows].tolist(), number[rows], cut[rows], *more)
            x, y = (rows if askers is None else askers)[a], rows[b]
            pairs.append((x, y))
            if askers is not None:
                pairs.append((y, x))
        if not pairs:
            return
        a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
        # Each pair counts in one group: that of its shorter word, and by its first half if it agrees there.
        size = np.fromiter(map(len, line), np.int64, len(line))
        good = np.minimum(size[a], size[b]) == m[a]
        for k in np.flatnonzero(good & (side[a] == 1)):
            h = half[a[k]]
            good[k] = h > 0 and line[a[k]][-h:] != line[b[k]][-h:]
        a, b = a[good], b[good]
        if not len(a):
            return
        plain = np.array([w[::-1] if s else w for w, s in zip(line[b], side[b], strict=True)], dtype=object)
        order = np.lexsort((plain, -n[b], a))
        a, b, plain = a[order], b[order], plain[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        count = np.diff(np.concatenate([head, [len(a)]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(side[a[head]], pa.int32()), pa.array(line[a[head]].tolist(), pa.string()), pa.array(count, pa.int64()),
             pa.array(n[b[head]], pa.int64()), pa.array(plain[head].tolist(), pa.string())],
            names=["side", "line", "near", "best_n", "best"],
        )

    held: list[pa.RecordBatch] = []
    weight = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, weight
        t = pa.Table.from_batches(held).combine_chunks()
        marks = [t.column(c).to_numpy() for c in ("side", "m", "i", "j")]
        part = t.column("part").combine_chunks()
        new = np.any([x[1:] != x[:-1] for x in marks], axis=0) | np.asarray(pa.compute.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False), bool)
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]])
        if not last:
            edges = edges[:-1]
        if len(edges) > 1:
            yield from cells(t.slice(0, int(edges[-1])), edges)
        held = t.slice(int(edges[-1])).to_batches()
        weight = sum(x.column("line").nbytes for x in held)

    import pyarrow.compute  # noqa: F401  used as pa.compute

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            weight += batch.column("line").nbytes
            if weight > BATCH:
                yield from flush(False)
    if held:
        yield from flush(True)


def word_counts(docs: DataFrame, least: int = 6, often: int = 5, typo: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur at least ``often`` times in all texts.

    A word is a maximal run of letters, A-Z as a-z. Where ``typo`` (0: never) divides the crc32 of '<id>:<word>', the code
    point at that number modulo the length is left out. Null texts have no words; a null id counts as an empty one.
    """
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    words = words.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run")).alias("run"))
    word = F.col("run")
    if typo:
        h = F.crc32(F.concat_ws(":", "id", "run"))
        gone = F.pmod(h, F.length("run")).cast("int")
        word = F.when(h % typo == 0, F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2))).otherwise(word)
    words = words.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def _half(word: Column, m: Column, side: int) -> Column:
    first = F.floor(m / 2).cast("int")
    return F.substr(word, F.lit(1), first if side == 0 else m - first)


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, best_n, best) for the words of ``vocabulary`` (word, n; distinct words) that have a near word.

    Near words differ by exactly one inserted, deleted or replaced code point; ``near`` counts them, ``best`` is that of largest n (ties:
    the smallest). Of two near words, the shorter of m code points, either the first half (m // 2) is equal or, read from the end,
    the other half is. So each word stands in the sorted list of its first half and, reversed, in that of its last half, for m = its length
    and m = one less, and ``near_in_lists`` scans each list. Each pair counts in one list only. Lists of more than ``block`` words
    are cut in blocks by hash, and every two blocks meet in a cell of their own, so no task grows with a frequent
    beginning. An empty vocabulary gives an empty result.
    """
    size = F.length("word")
    sides = []
    for side in (0, 1):
        line = F.col("word") if side == 0 else F.reverse("word")
        for less in (0, 1):
            m = size - less
            sides.append(F.struct(F.lit(side).alias("side"), m.alias("m"), _half(line, m, side).alias("part"), line.alias("line")))
    rows = vocabulary.filter(size > 0).select("n", F.inline(F.array(*sides))).filter("m > 0")
    # Alone in a list there is nothing to compare; of the others, only long lists need a number of blocks.
    counts = rows.groupBy("side", "m", "part").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block)
    long = materialise(counts.select("side", "m", "part", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "long-lists")
    rows = rows.join(small_side(long, 200_000), ["side", "m", "part"], "left").fillna({"blocks": 1})
    rows = rows.withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    key = ["side", "m", "part", "i", "j"]
    rows = rows.select(*key, "block", "line", "n").repartition(*key).sortWithinPartitions(*key, "line")
    found = rows.mapInArrow(_scan, FOUND).withColumn("word", F.when(F.col("side") == 1, F.reverse("line")).otherwise(F.col("line")))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select(
        "word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")
    )


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of links (word, form) that lead to ever more frequent words, ``most`` links in a row at most.

    Every round doubles the steps taken, and is written to the shared folder.
    """
    jumps = materialise(forms.select("word", F.col("form").alias("root")), "jumps")
    for _ in range(max(0, math.ceil(math.log2(max(1, most))))):
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = materialise(jumps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "jumps")
    return jumps


def spelling_variants(
    docs: DataFrame, ratio: int = 5, least: int = 6, often: int = 5, typo: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n.

    For words and near words see ``word_counts`` and ``near_words``. A word's ``form`` is its most frequent near word, if that is at least
    ``ratio`` (2 or more) times as frequent, else null; ``root`` is where the forms lead in the end, the word itself if it has none. Null and
    empty texts add nothing, texts are read whole, repeated rows count each, other columns are ignored, and an empty table gives an
    empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = materialise(word_counts(docs, least, often, typo, id_col, text_col), "words")
    out = words.join(near_words(words, block), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    out = materialise(out, "forms")
    top = out.agg(F.max("n")).first()[0] or 1
    last = roots(out.filter("form is not null"), int(math.log(top, ratio)) + 1)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
