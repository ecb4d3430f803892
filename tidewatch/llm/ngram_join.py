"""Similarity self-join on word shingles: size-banded tiles, bitmap bounds, exact intersections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, few, private, row_key, sized, small_side
from tidewatch.llm.components import components
from tidewatch.llm.textarrays import U, mix, shingles, word_hashes
from tidewatch.session import Workspace, materialise

#: Ratio of neighbouring band edges, and rows of a tile that are compared in one cell.
BAND, BLOCK = 1.5, 2048


class Bands:
    """Sizes in bands, and into how many parts the shingles of a band's sets are dealt.

    Sets x, y are linked if 100 * |x & y| >= percent * |x | y|, that is if they differ in at most
    (100 - percent) * (|x| + |y|) / (100 + percent) shingles. Shingles are dealt into parts by their hash. With one part
    more than the bound allows differences, linked sets agree on a whole part. Some parts hold next to nothing
    (at most ``weak`` shingles) and would bring unrelated sets together, so there are ``spare`` parts more: a set with at most
    ``spare`` weak parts agrees with any partner on a part that is not weak. A set with more gives its weak parts too.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.weak = 1 if percent >= 90 else 0

    def edge(self, band: int) -> int:
        return math.ceil(BAND**band)

    def band(self, size: int) -> int:
        k = max(0, int(math.log(size, BAND)) - 1)
        while self.edge(k + 1) <= size:
            k += 1
        return k

    def differ(self, both: int) -> int:
        return (100 - self.percent) * both // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019  one small entry for each band
    def shape(self, band: int) -> tuple[int, int, int]:
        """Parts, spare parts and bits of the bitmap for pairs whose larger set is in this band."""
        largest = self.edge(band + 1) - 1
        bound = self.differ(2 * largest)
        spare = 0
        while bound:
            held = self.percent / 100 * self.edge(band) / (bound + 1 + spare)  # shingles in a part of the smallest set
            rare = math.exp(-held) * (1 + held * self.weak)
            if spare >= 2 + rare * (bound + 1 + spare) * 0.7 or spare >= bound + 2:
                break
            spare += 1
        bits = 64
        while bits < 8 * bound:
            bits *= 2
        return bound + 1 + spare, spare, bits

    def groups(self, size: int) -> list[int]:
        """The bands of the larger partner in which a set of this size may be linked."""
        last = own = self.band(size)
        while 100 * size >= self.percent * self.edge(last + 1):
            last += 1
        return list(range(own, last + 1))


def _signatures(v: np.ndarray, bands: Bands) -> tuple[np.ndarray, bytes]:
    """One key for each part of a set in each of its bands, and its parity bitmap."""
    own = bands.band(len(v))
    bits = bands.shape(own)[2]
    place = (v >> U(7)) & U(bits - 1)
    odd = (np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(bool)
    keys = []
    second = mix(v ^ U(0xA5A5A5A5A5A5A5A5))
    low, high = (second & U(0xFFFFFFFF)).astype(np.float64), (second >> U(32)).astype(np.float64)
    for band in bands.groups(len(v)):
        parts, spare, _ = bands.shape(band)
        if parts == 1:
            continue  # only equal sets
        part = ((v >> U(20)) % U(parts)).astype(np.int64)
        n = np.bincount(part, minlength=parts)
        # Sums of up to 2**20 halves are exact in a double.
        a = np.bincount(part, low, parts).astype(U)
        b = np.bincount(part, high, parts).astype(U)
        key = mix(mix(mix(a) + (b << U(20))) + np.arange(parts, dtype=U) * U(0x9E3779B97F4A7C15) + U(band + 1))
        weak = n <= bands.weak
        keys.append(key if weak.sum() > spare else key[~weak])
    return (np.concatenate(keys) if keys else v[:0]), np.packbits(odd).tobytes()


def _digest(v: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(v * U(k) + U(len(v))).sum(dtype=U).astype(np.int64)) for k in (1, 0x9FB21C651E98DF25))


def _features(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            sets = word_hashes(batch.column("text").to_pylist())
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                size, one, two, sketch, counts, keys, maps = [], [], [], [], [0], [], []
                for _ in range(part.num_rows):
                    v = shingles(next(sets), n)
                    d = _digest(v) if len(v) else (None, None)
                    k, m = _signatures(v, bands) if len(v) else (v, b"")
                    size.append(len(v))
                    one.append(d[0])
                    two.append(d[1])
                    sketch.append(int(v[0] >> U(1)) if len(v) else 0)
                    counts.append(counts[-1] + len(k))
                    keys.append(k.view(np.int64))
                    maps.append(m)
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array(sketch, pa.int64()), lists, pa.array(maps, pa.binary())],
                    names=["id", "key", "size", "one", "two", "sketch", "keys", "bits"],
                )

    return run


def _sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            held: list[bytes] = []
            at = 0
            for words in word_hashes(batch.column("text").to_pylist()):
                held.append(shingles(words, n).tobytes())
                if len(held) == 500:
                    yield pa.RecordBatch.from_arrays([keys.slice(at, 500), pa.array(held, pa.binary())], names=["key", "items"])
                    at, held = at + 500, []
            if held:
                yield pa.RecordBatch.from_arrays([keys.slice(at), pa.array(held, pa.binary())], names=["key", "items"])

    return run


def _fold(bits: bytes, words: int) -> np.ndarray:
    """A parity bitmap of more bits, cut to ``words`` 64-bit words; the parities of the halves add up."""
    x = np.frombuffer(bits, dtype=U)
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def _may_link(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose bitmaps do not rule the link out: sets differ in at least as many shingles as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "ba", "bb")), strict=True)
            for sa, sb, ba, bb in rows:
                w = min(len(ba), len(bb)) // 8
                differ = int(np.bitwise_count(_fold(ba, w) ^ _fold(bb, w)).sum())
                keep.append(100 * min(sa, sb) >= percent * max(sa, sb) and differ * (100 + percent) <= (100 - percent) * (sa + sb))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cells(percent: int, nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of different components in a cell that the bitmaps do not rule out; with ``nearest`` for each row only the
    one with the closest bitmap among the rows after it. Rows come sorted by cell."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp, size, block = (t.column(c).to_numpy() for c in ("node", "comp", "size", "block"))
        maps = t.column("bits").to_pylist()
        if len(node) < 2 or (comp == comp[0]).all():
            return
        w = min(map(len, maps)) // 8
        grid = np.stack([_fold(m, w) for m in maps])
        cross = (block != block[0]).any()
        for i in range(len(node) - 1):
            other = comp[i + 1 :] != comp[i]
            if cross:
                other &= block[i + 1 :] != block[i]
            near = np.flatnonzero(other)
            if not len(near):
                continue
            near += i + 1
            both = size[near] + size[i]
            differ = np.bitwise_count(grid[near] ^ grid[i]).sum(axis=1, dtype=np.int64)
            fits = 100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])
            fits &= differ * (100 + percent) <= (100 - percent) * both
            near, differ = near[fits], differ[fits]
            if nearest:
                near = near[differ.argmin() :][:1] if len(near) else near
            if len(near):
                a, b = np.minimum(node[near], node[i]), np.maximum(node[near], node[i])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            marks = [t.column(c).to_numpy() for c in ("tile", "i", "j")]
            new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from pairs(t.slice(a, b - a))
            held = t.slice(edges[-1]).combine_chunks()
        if held is not None:
            yield from pairs(held)

    return run


def _shared(tiles: DataFrame) -> DataFrame:
    """The distinct (tile, node) of tiles with two nodes or more, after a single shuffle.

    Rows that repeat a node stand side by side: of the first node of a tile the last row stays, of any other the first.
    """
    line = Window.partitionBy("tile").orderBy("node")
    tiles = tiles.withColumns({"prev": F.lag("node").over(line), "next": F.lead("node").over(line), "place": F.rank().over(line)})
    return tiles.filter("prev <> node or (place = 1 and next <> node)").select("tile", "node")


def _representatives(docs: DataFrame, work: Workspace, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, size, component, stays): ``component`` is the smallest real id of the component or null, ``stays`` the key that represents it."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    schema = "id long, key long, size long, one long, two long, sketch long, keys array<long>, bits binary"
    full = work.write(base.mapInArrow(_features(n, percent), schema), "shingles")
    rows = work.write(full.select("id", "key", "size", "one", "two"), "sizes")
    total = rows.count()
    same = rows.filter("size > 0").groupBy("one", "two").agg(F.min("key").alias("node"), F.min("id").alias("least"))
    same = work.write(sized(same, total), "sets")
    nodes = full.join(same.select(F.col("node").alias("key")), "key", "left_semi")

    tiles = work.write(_shared(nodes.select(F.col("key").alias("node"), F.explode("keys").alias("tile"))), "tiles")
    met = tiles.count()
    wanted = work.write(sized(tiles.select("node").distinct(), met), "wanted")
    count = wanted.count()
    traits = nodes.select(F.col("key").alias("node"), "size", "sketch", "bits")
    traits = work.write(traits.join(small_side(wanted), "node", "left_semi"), "traits")
    work.drop(full, wanted)

    def verified(pairs: DataFrame, held: int) -> DataFrame:
        """The pairs that are linked. Sets are made again of the texts of the documents that are asked for: they would take more room than these."""
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        ends = work.write(sized(ends, held), "ends")
        sets = base.join(small_side(ends), "key", "left_semi").select("key", "text").mapInArrow(_sets(n), "key long, items binary")
        sets = sets.dropDuplicates(["key"]) if rows_repeat else sets
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("key").alias(end), F.col("items").alias(f"i{end}")), end)
        out = work.write(pairs.mapInArrow(_linked(percent), "a long, b long"), "linked")
        work.drop(ends)
        return out

    # Rows that repeat a key have the same text or are the same document; one of their sets is enough.
    rows_repeat = total > rows.agg(F.count_distinct("key")).first()[0]
    order = Window.partitionBy("tile").orderBy("sketch", "node")
    close = tiles.join(few(traits.select("node", "sketch"), count), "node").select("node", F.lag("node").over(order).alias("prev"))
    close = close.filter("prev <> node").select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b"))
    tried = work.write(sized(close.distinct(), met), "close")
    near = tried
    for end in ("a", "b"):
        near = near.join(traits.select(F.col("node").alias(end), F.col("size").alias(f"s{end}"), F.col("bits").alias(f"b{end}")), end)
    near = work.write(near.mapInArrow(_may_link(percent), "a long, b long"), "near")
    links = verified(near, near.count())
    found = components(links, work)
    work.drop(near, links)

    for nearest in (True, False):
        comps = tiles.join(few(found, count), "node", "left").select("tile", "node", F.coalesce("label", "node").alias("comp"))
        mixed = comps.groupBy("tile").agg(
            F.count(F.lit(1)).alias("rows"), F.min("comp").alias("x"), F.max("comp").alias("y"),
            F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("also"),
        ).filter("rows > 2 and x <> y")
        # Similar sets share many tiles with the same members (told by two 64-bit hashes of them); one of these is enough.
        mixed = mixed.groupBy("rows", "who", "also").agg(F.min("tile").alias("tile")).select("tile", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
        mixed = work.write(mixed, "mixed")
        cells = comps.join(small_side(mixed, 500_000), "tile").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("tile", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "comp", "block")
        cells = cells.join(traits.select("node", "size", "bits"), "node").repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
        more = cells.mapInArrow(_cells(percent, nearest), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        more = work.write(more, "pairs")
        held = more.count()
        if held:
            tried = tried.unionByName(more)
            links = verified(more, held)
            before, found = found, components(links.unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b"))), work)
            work.drop(before, links)
        work.drop(mixed)

    # The smallest real id of each component; most nodes are alone and keep the least id of their equal sets.
    named = same.join(found, "node", "left").select("one", "two", "node", "least", F.coalesce("label", "node").alias("label"))
    linked = named.join(found.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("least").alias("name"), F.min("node").alias("lowest"))
    named = named.join(linked, "label", "left").select(
        "one", "two", F.coalesce("name", F.when(F.col("lowest").isNull(), F.col("least"))).alias("component"), F.coalesce("name", F.coalesce("lowest", "least", "node")).alias("first")
    )
    out = rows.join(named, ["one", "two"], "left")
    return out.select("id", "key", "size", "component", F.coalesce("component", "first").alias("stays"))


def shingle_components(
    docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links).

    A document's set holds its distinct runs of ``n`` words; with fewer words all of them as one run. Two documents are
    linked if 100 * intersection >= ``percent`` * union. A null or empty text, or one of white space, has an empty set
    and is linked with nothing. Rows that repeat an id count as one document; a row without id takes part under a key of
    its text and gets the smallest real id it is linked with, or null. Other columns are ignored. Texts of any length are
    read whole. Shingles are compared by 64-bit hashes.

    1. One pass gives each document's size, digest, tile keys (see ``Bands``) and bitmap. Equal sets are one node.
    2. Sets that share a key meet in a tile. In each tile neighbours in a similarity-preserving order (least shingle
       hash) make candidate pairs, so a tile gives fewer pairs than rows. Bitmaps bound the overlap from
       above, sorted arrays are intersected exactly for what is left.
    3. Tiles of three or more sets that still hold several components are compared in full, in cells of at most
       2 * BLOCK rows. First each set proposes the closest one of another component, again at most a pair for each
       row; what is then still in different components and not ruled out by the bitmaps is verified pair by pair. So no
       link is lost, and a large group of near copies costs little once it is connected.
    """
    with Workspace(docs.sparkSession, "ngram-join") as work:
        out = _representatives(docs, work, n, percent, id_col, text_col).select(
            F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
            F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        )
        return materialise(out, "components")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if of each component the document with the smallest id is kept.

    Documents with an empty set are all kept. Rows that repeat the id that stays are one document and all stay. A row without id goes if its
    component has a document with an id; of a component without any id one row stays. All columns are kept as they are.
    """
    with Workspace(docs.sparkSession, "near-copies") as work:
        found = _representatives(docs, work, n, percent, id_col, text_col).filter((F.col("size") > 0) & (F.col("key") != F.col("stays")))
        (gone,) = private(docs, "gone")
        go = materialise(found.select(F.col("key").alias(gone)).distinct(), "near-copies")
    kept = docs.join(small_side(go), row_key(id_col, text_col) == F.col(gone), "left_anti")
    if kept.filter(F.col(id_col).isNull()).isEmpty():
        return kept
    # Of equal texts without id one row stays, told by its other columns; texts without a word are no copies.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    bare = kept.filter(F.col(id_col).isNull())
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    one = bare.filter(~wordless).groupBy(row_key(id_col, text_col).alias("key")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return kept.filter(F.col(id_col).isNotNull()).unionByName(bare.filter(wordless)).unionByName(one.select("row.*"))
