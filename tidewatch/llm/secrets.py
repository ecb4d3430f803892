"""Secret scan with an inverted index of the trigrams that the rules require."""

from __future__ import annotations

import re._parser as sre
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_side
from tidewatch.session import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, without overlaps; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: The base rules, then rules of known key formats. A bounded repetition stands for a length test where both agree.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)

#: A character class larger than this stands for "any character" in the trigram query.
WIDE = 8


def _variants(node: Sequence, fold: bool) -> list[list[str | None]]:
    """Sequences of letters that any match contains side by side; None is a gap of unknown text."""
    runs: list[list[str | None]] = [[]]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            c = chr(arg)
            parts = [[c.lower() if fold or c.isascii() else None]]
        elif name == "IN":
            chars = [chr(a) for o, a in arg if str(o) == "LITERAL"]
            plain = len(chars) == len(arg) and len(chars) <= WIDE
            parts = [[c.lower()] for c in chars] if plain else [[None]]
        elif name == "SUBPATTERN":
            parts = _variants(arg[3], fold)
        elif name == "BRANCH":
            parts = [v for branch in arg[1] for v in _variants(branch, fold)]
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            once = _variants(inner, fold)
            if (low, high) == (0, 1) and len(once) == 1 and len(once[0]) == 1 and once[0][0] is not None and once[0][0].isalnum() | (once[0][0] == "_"):
                parts = [[], *once]
            else:
                parts = [[*v * min(low, 3), None] for v in once] if low and len(once) == 1 else [[None]]
        else:
            parts = [[None]]
        runs = [a + b for a, b in product(runs, parts)]
    return runs


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Boolean query, an OR of ANDs of lower-case trigrams, that every text with a match satisfies.

    None if some way to match has no trigram of its own; such a rule must look at every text.
    """
    branches = set()
    for run in _variants(sre.parse(pattern), False):
        grams = {"".join(run[i : i + 3]) for i in range(len(run) - 2) if None not in run[i : i + 3]}
        if not grams:
            return None
        branches.add(frozenset(grams))
    return sorted((b for b in branches if not any(o < b for o in branches)), key=sorted)


def build_index(docs: DataFrame, grams: Sequence[str], key: Column, text: Column) -> DataFrame:
    """Postings (gram, key) of the trigrams that any rule asks for; letters A-Z count as a-z."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    there = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(n)) for n, g in enumerate(grams)]))
    return docs.select(key.alias("key"), low.alias("low")).select("key", F.explode(there).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: Column, text: Column) -> DataFrame:
    """(key, rules): the indexed rules whose Boolean query a text satisfies, as an array of positions in ``rules``.

    A conjunction holds where the postings of all its trigrams meet on a key; their bits are combined before the shuffle.
    """
    spark = docs.sparkSession
    queries = [(n, q) for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None]
    grams = sorted({g for _, q in queries for b in q for g in b})
    wanted = [
        (grams.index(g), n, k, 1 << i, (1 << len(b)) - 1)
        for n, q in queries for k, b in enumerate(q) for i, g in enumerate(sorted(b))
    ]
    schema = "gram int, rule int, branch int, bit long, whole long"
    if not wanted:
        return spark.createDataFrame([], "key long, rules array<int>")
    postings = materialise(build_index(docs, grams, key, text), "postings")
    asked = F.broadcast(spark.createDataFrame(wanted, schema))  # one row for each trigram of the rules
    return (
        postings.join(asked, "gram")
        .groupBy("key", "rule", "branch", "whole").agg(F.bit_or("bit").alias("met")).filter("met = whole")
        .groupBy("key").agg(F.collect_set("rule").alias("rules"))  # at most one entry for each rule
    )


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed one time, however often the body reads it, also in functions of array elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Array of the running sums of an array of ints.

    An array that is built by adding one element at a time is copied each time, so the sums are built in blocks of about the square root of
    the size: first the sum of each block, then where each begins, then the sums within.
    """
    width = F.ceil(F.sqrt(F.greatest(F.size(lengths), F.lit(1)))).cast("int")  # read anew for each block, from the size alone
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / width).cast("int"))
    blocks = F.transform(numbers, lambda k: F.slice(lengths, k * width + 1, width))

    def sums(values: Column, first: Column) -> Column:
        start = F.array(first)
        return F.aggregate(values, start, lambda out, v: F.concat(out, F.array(F.element_at(out, -1) + v)))

    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    begins = sums(totals, F.lit(0))
    return F.flatten(F.zip_with(F.slice(begins, 1, F.size(numbers)), blocks, lambda s, x: F.slice(sums(x, s), 2, F.greatest(F.size(x), F.lit(1)))))


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end, good), in code points, of one rule.

    One pass of the regex puts marks around every match, and the group that counts behind it. Between the marks stand, in turn, skipped text, a match
    (and its group); running lengths of the first two give the positions. A mark that the text itself holds becomes
    another character before, which no rule asks for.
    """
    mark, parts = "\x00", 2 if rule.group == 0 else 3
    marked = F.regexp_replace(F.translate(text, mark, "\x01"), F.lit(rule.pattern), F.lit(f"{mark}$0{mark}" + f"${rule.group}{mark}" * (parts == 3)))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int,good:boolean>>")

    def found(lengths: Column, ends: Column) -> Column:
        count = F.floor(F.size(lengths) / parts).cast("int")
        spans = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.struct(
                F.element_at(ends, 2 * k + 1).alias("start"), F.lit(rule.kind).alias("kind"), F.element_at(ends, 2 * k + 2).alias("end"),
                (F.element_at(lengths, k * parts + parts) >= rule.least).alias("good"),
            ),
        )
        return F.when(count > 0, F.filter(spans, lambda s: s["good"])).otherwise(empty)

    def placed(lengths: Column) -> Column:
        moves = F.filter(lengths, lambda x, i: i % parts < 2) if parts == 3 else lengths
        return once(once(moves, running), lambda ends: found(lengths, ends))

    return once(F.transform(F.split(marked, mark, -1), lambda x: F.length(x)), placed)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (start, end, kind, base) by start, then rule order.

    Positions are code points, the end is exclusive. A null text counts as empty, texts of any length are read whole,
    repeated rows are answered each, an empty table gives an empty result, other columns are ignored.

    Each regex gives a Boolean query of trigrams that all its matches contain. The postings of just these trigrams
    are written once and intersected; a rule is verified only on the texts whose postings satisfy its query. A rule
    without mandatory trigrams (hexadecimal runs) is matched on every text, in the pass that verifies the others.
    The candidate keys are broadcast if their counted number is small, else joined by an ordinary shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))  # equal keys only widen the set of candidates
    found = materialise(candidates(docs, rules, key, text), "candidates")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"))
    rows = rows.join(small_side(found), "key", "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int,good:boolean>>")
    parts = []
    for n, rule in enumerate(rules):
        may = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("rules", n), F.lit(False))
        parts.append(F.when(may & F.col("text").rlike(rule.pattern), _spans(F.col("text"), rule)).otherwise(none))
    order = {r.kind: n for n, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    base = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.base)])
    spans = F.transform(
        F.flatten(F.array(*parts)),
        lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), base[s["kind"]].alias("base")),
    )
    return rows.select(F.col("id").alias(id_col), F.array_sort(spans).alias("spans"))
