"""Spelling variants, whitening and nearest neighbours against brute force; odd names, repeats, rows without id and hard texts for all operators."""

from __future__ import annotations

import gzip
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import chat, decontaminate, exact_dedup, language, mixing, neighbours, ngram_join, queries, secrets, sharding, spelling, toxicity, warc, whitening
from tidewatch.llm.common import bounded_sample

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- 13 spelling variants


def _one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(docs, typo=0, least=6, often=5, ratio=5):
    low = str.maketrans(spelling.UPPER, spelling.UPPER.lower())
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= often}
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("block", [3, 8192])
def test_variants_match_brute_force(spark, block):
    """Dense words over few letters, with accents, a frequent beginning and chains of forms; blocks of three words as well."""
    rnd = random.Random(13)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 6))) for _ in range(60)] + ["common" + "".join(rnd.choice("xy") for _ in range(3)) for _ in range(12)]
    docs = [(i if i % 9 else None, " ".join(rnd.choice(stems).upper() if rnd.random() < 0.2 else rnd.choice(stems) for _ in range(60)) + " ÷") for i in range(40)]
    docs += [(100, "abcdef " * 2), (101, "abcdeg " * 12 + "abcdeh " * 70 + "abcdex " * 400), (102, None), (103, ""), (104, "é" * 9 + " " + "ab" * 40_000)] + [(105, "abcdef " * 3)] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    for typo, least in ((0, 4), (3, 6)):
        got = [tuple(r) for r in spelling.spelling_variants(frame, typo=typo, least=least, block=block).collect()]
        want = _variants(docs, typo, least)
        assert len(got) == len(set(got)) and set(got) == want
        assert any(w[1] for w in want) and any(w[4] > 1 for w in want)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_list_scan_matches_brute_force():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(300)})
    zero = np.zeros(len(words), np.int64)
    a, b = spelling.near_in_lists(words, zero, zero)
    assert {(words[i], words[j]) for i, j in zip(a, b, strict=True)} == {(v, w) for v in words for w in words if _one_edit(v, w)}
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True)))


# --- 11 whitening


def _whitened(frame, **options):
    out = whitening.whitened_components(frame, **options).toPandas()
    return out, out.pivot(index="vec_id", columns="component", values="whitened")


def test_whitening_matches_a_full_decomposition(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 12)) @ np.diag([9, 9, 5, 4, 3, 2, 1, 1, 1, 0.5, 0.2, 0.1]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 3
    rows = [(i, r.tolist(), 1) for i, r in enumerate(v)]
    odd = [(1000, None, 1), (1001, [1.0] * 11 + [None], 1), (1002, [1.0] * 11 + [float("nan")], 1), (1003, [float("inf")] + [0.0] * 11, 1), (1004, [], 1), (1005, [1.0] * 5, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, x int").withColumn("n", F.lit("clash"))
    out, wide = _whitened(frame, components=8)
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    e = n * x - s
    values, vectors = np.linalg.eigh((e / n).T @ (e / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert wide.shape == (400, 8) and set(wide.index) == set(range(400))
    want = (e / n) @ vectors[:, :8] / np.sqrt(values[:8])
    sign = np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.abs(wide.to_numpy() * sign - want).max() < 1e-8
    told = out.drop_duplicates("component").sort_values("component")
    assert np.allclose(told.explained, values[:8] / values.sum(), rtol=1e-9) and (told.identity_error < 1e-9).all() and (told.n == n).all()
    assert out.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[range(400)].tolist() == np.square(e).sum(axis=1).tolist()


def test_whitening_of_repeated_deviations_low_rank_and_few_rows(spark):
    make = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.asarray(v, float))], "vec_id long, embedding array<double>")
    signs = np.array([[1 if i >> k & 1 else -1 for k in range(6)] for i in range(64)])  # six equal variances
    out, wide = _whitened(make(signs))
    assert wide.shape == (64, 6) and np.allclose(wide.T @ wide / 64, np.eye(6), atol=1e-10) and np.allclose(out.explained, 1 / 6)
    flat = np.column_stack([signs[:, :2], signs[:, 0] + signs[:, 1], np.full(64, 7)])  # rank two
    out, wide = _whitened(make(flat))
    assert wide.shape == (64, 2) and (out.identity_error < 1e-9).all()
    assert whitening.whitened_components(make([[1.0, 2.0]] * 3)).count() == 0  # no deviation at all
    assert whitening.whitened_components(make(np.zeros((0, 2)))).count() == 0
    out, wide = _whitened(make([[0.0, 1.0], [0.0, 3.0], [0.0, 3.0]]))
    assert wide.shape == (3, 1) and wide.loc[1, 1] == wide.loc[2, 1]
    big = _whitened(make([[1e13, 0.0], [0.0, 1e13], [1.0, 1.0]]))[0]
    assert big.deviation.isna().all() and len(big) == 6


# --- 12 nearest neighbours


def _nearest(ids, v, asked, k):
    good = [i for i, x in enumerate(v) if x is not None and len(x) == 8 and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    scaled = {i: np.asarray(v[i], float) / np.abs(v[i]).max() for i in good}
    unit = {i: x / np.linalg.norm(x) for i, x in scaled.items()}
    out = {}
    for i in good:
        if asked(ids[i]):
            out[ids[i]] = sorted(((-float(unit[i] @ unit[j]), ids[j]) for j in good if ids[j] != ids[i]))[:k]
    return out


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8)) * 3
    v = [(centres[rng.integers(12)] + rng.normal(size=8)).tolist() for _ in range(1500)]
    v += [[1.0] * 8] * 300 + [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0] * 7 + [None], [], [1.0] * 3] + [[2.0] * 8, [2.0**-600] * 8]
    ids = list(range(len(v)))
    frame = spark.createDataFrame(list(zip(ids, v, strict=True)), "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    frame = frame.unionByName(frame.filter("vec_id < 40")).unionByName(frame.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0, k=5, rows_per_cell=100, queries_per_cell=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = _nearest(ids, v, lambda i: i % 50 == 0, 5)
    assert got.keys() == want.keys() and all([x[0] for x in g] == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({x[1] for x in got[q]} & {j for _, j in w}) for q, w in want.items())
    assert hits >= 0.95 * 5 * len(want)
    # Copies of one vector tie, and the smallest ids are named.
    assert [x[1] for x in got[1600]] == [1500, 1501, 1502, 1503, 1504] and [x[1] for x in got[1500]] == [1501, 1502, 1503, 1504, 1505]
    for q, rows in got.items():
        for _, j, score in rows:
            a, b = (np.asarray(v[x], float) / np.abs(v[x]).max() for x in (q, j))
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2)] and got[1][3] == -1.0
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0 and neighbours.nearest(few, F.lit(False)).count() == 0


# --- names, repeats and rows without id in all operators and stages

CLASH = ["id", "__id", "key", "row", "number", "copies", "size", "shard_", "bytes", "gone", "h", "label", "score_", "one", "tile", "text2", "kind"]


def test_clashing_names_in_all_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    docs = docs.withColumns({c: F.lit("kept") for c in CLASH}).withColumn("score", F.lit("mine"))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near_copies", "decontamination", "mixing"):
        out = stages[name](spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns) and out.filter("score <> 'mine' or id <> 'kept' or __id <> 'kept'").count() == 0 and out.count() > 0, name
    out = sharding.shard_documents(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.filter("bytes <> 'kept'").count() == 0 and out.count() == 60
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").withColumns({c: F.lit("x") for c in ("start", "id", "edits", "body", "item")})
    assert decontaminate.find_passages(docs, bench).count() >= 0
    assert exact_dedup.mark_copies(docs).count() == secrets.scan_secrets(docs).count() == mixing.plan_mix(docs).count() == 60
    assert ngram_join.shingle_components(docs).count() == 60
    known = docs.select(F.col("doc_id").alias("id"), "text", "lang", F.lit(1).alias("h"))
    assert language.identify_language(docs.limit(5), language.train(known)).count() == 5
    model = toxicity.train(known, known.select("id", (F.col("id") % 2).alias("label")))
    assert toxicity.score_toxicity(docs, model).filter("score between 0 and 1").count() == 60
    rows = spark.read.parquet(f"{SF}/conversations.parquet").withColumns({c: F.lit("x") for c in ("nth", "seq", "kind", "head", "body", "loss", "log", "begin")})
    assert chat.read_back(chat.format_conversations(chat.rows_to_events(rows))).count() == rows.select("conv_id").distinct().count()
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumns({c: F.lit("x") for c in ("payload", "first", "n", "payload_digest", "record_type", "headers")})
    assert warc.page_records(pages).count() == pages.count()


def test_stages_decide_on_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near = " ".join(f"w{i}" for i in range(1, 80))
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, text, "en", "b", 2), (None, near, "en", "a", 1), (None, "other words " * 20, "en", "a", 1), (None, None, None, None, None), (None, "", "en", "a", 0), (None, "", "en", "a", 0)]
    kept = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert Counter(k[1] for k in kept if k[1])["other words " * 20] == 1 and len([k for k in kept if not k[1]]) == 3
    assert len([k for k in kept if k[1] in (text, near)]) == 1
    kept = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame([*rows, (5, near, "en", "a", 1)], DOCS)).collect()]
    assert [k[0] for k in kept if k[1] in (text, near)] == [5]
    passage = "the quick brown fox jumps over the lazy dog while nine zebras watch from a distant hill and quietly count all the stars above"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"before {passage} after", "en", "a", 1), (None, "clean", "en", "a", 1), (None, None, None, None, None)], DOCS)
    assert sorted(str(r.text) for r in decontaminate.drop_contaminated(docs, bench).collect()) == ["None", "clean"]
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 3
    # 600 rows of two sources without id: each source's words come near its target, and reruns agree.
    many = spark.createDataFrame([(None, " ".join(["w"] * (1 + i % 20)) + f" t{i}", "en", "ab"[i % 2], i) for i in range(600)], DOCS)
    told = {r.source: (r.source_size, r.target) for r in mixing.plan_mix(many).select("source", "source_size", "target").distinct().collect()}
    first = Counter(tuple(r) for r in mixing.mix_documents(many).collect())
    again = Counter(tuple(r) for r in mixing.mix_documents(many.repartition(7)).collect())
    assert first == again
    for source, (_, target) in told.items():
        assert abs(sum(len(r[1].split()) * n for r, n in first.items() if r[3] == source) - target) <= 60


def test_mixture_takes_the_same_rows_whatever_the_cells(spark):
    rows = [(i // 2 if i % 5 else None, f"same size {'x' if i % 7 else i}", "en", "ab"[i % 2], i) for i in range(400)] + [(9, "all the same", "en", "a", 1)] * 100
    docs = spark.createDataFrame(rows, DOCS)
    plans = [Counter(tuple(r) for r in mixing.plan_mix(docs, rows_per_cell=n).collect()) for n in (10**6, 30, 7)]
    assert plans[0] == plans[1] == plans[2]


def test_training_rows_stay_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"t{i % 50}") for i in range(3000)] + [(2, "u"), (2, "u"), (None, "n")], "id long, text string")
    picks = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "id long, label int")
    got = Counter((r.id, r.label, r.text) for r in bounded_sample(docs, picks, "label", 20).collect())
    assert max(got.values()) == 1 and len([k for k in got if k[1] == 0]) == 20 and [k for k in got if k[1] == 1] == [(2, 1, "u")]


# --- hard texts


def test_secret_spans_match_python_on_many_matches(spark):
    rnd = random.Random(6)
    part = lambda: rnd.choice(["password=abcdefg1 ", "Secret: x ", "deadbeef" * 3 + " ", "\x00", "é😀 ", "AKIA" + "A" * 17 + "!", "token = 'abcdef' ", "api_key:abcdefgh\n"])
    texts = ["".join(part() for _ in range(n)) for n in (1, 2, 5, 40, 3000)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    order = {r.kind: n for n, r in enumerate(secrets.RULES)}
    for i, text in enumerate(texts):
        want = []
        for rule in secrets.RULES:
            for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text):
                if len(m[rule.group]) >= rule.least:
                    want.append((rule.kind, m.start(), m.end()))
        assert got[i] == sorted(want, key=lambda s: (s[1], order[s[0]])), i
    long = spark.createDataFrame([(1, ("0123456789abcdef" * 2 + " ") * 60_000)], "doc_id long, text string")
    began = time.time()
    assert secrets.scan_secrets(long).select(F.size("spans")).first()[0] == 60_000 and time.time() - began < 60


def test_repetitive_text_is_searched_in_bounded_time():
    index = decontaminate.Index([(i, f"Question {i}: fill the blank {'_' * 40} and say why it is {i * 7919} now") for i in range(50)], decontaminate.Settings())
    began = time.time()
    assert {x[0] for x in index.search("_" * 8_000)} <= set(range(50))
    said = "x" * 500 + f"Question 7: fill the blank {'_' * 40} and say why it is {7 * 7919} now" + "y" * 500
    assert 7 in {x[0] for x in index.search("_" * 5000 + said)} and time.time() - began < 60


# --- archives and chats


def test_archives_add_up_and_overwrite(spark, tmp_path):
    make = lambda ids: warc.page_records(spark.createDataFrame([(i, f"u{i}", f"body {i}") for i in ids], "page_id long, url string, html string"))
    ids = lambda: sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path), ["page_id"]).collect())
    warc.write_warc(make([1, 2]), str(tmp_path))
    warc.write_warc(make([10, 11]), str(tmp_path), compression="gzip")
    assert ids() == [1, 2, 10, 11]
    (tmp_path / "stray.warc").write_bytes(b"WARC/1.1\r\n\r\n")  # of an attempt that was never committed
    assert ids() == [1, 2, 10, 11]
    warc.write_warc(make([5]), str(tmp_path), mode="overwrite")
    assert ids() == [5]
    warc.write_warc(make([6]), str(tmp_path))
    assert ids() == [5, 6]


@pytest.mark.parametrize("packed", [False, True])
def test_truncated_and_altered_archives_raise(spark, tmp_path, packed):
    row = {"record_type": "response", "record_id": "r", "target_uri": None, "page_id": 1, "refers_to": None, "payload_digest": "0" * 40, "payload_length": None, "payload": bytes(random.Random(1).randbytes(5000))}
    data = warc.encode_record(row)
    end = ".warc.gz" if packed else ".warc"
    whole = tmp_path / f"whole{end}"
    whole.write_bytes(gzip.compress(data) if packed else data)
    got = warc.read_warc(spark, str(whole)).collect()
    assert got[0].payload == row["payload"] and got[0].payload_length is None
    for n, cut in enumerate((len(data) - 1500, 40)):
        part = tmp_path / f"cut{n}{end}"
        part.write_bytes(gzip.compress(data)[: (cut if n else -1500)] if packed else data[:cut])
        for fields in (["payload"], ["page_id"]):
            with pytest.raises(PySparkException):
                warc.read_warc(spark, str(part), fields).collect()
    with pytest.raises(PySparkException):
        warc.read_warc(spark, str(whole), verify=True).collect()
    foreign = tmp_path / "foreign.warc"
    foreign.write_bytes(b"not an archive\r\n")
    with pytest.raises(PySparkException):
        warc.read_warc(spark, str(foreign)).collect()


def test_conversations_are_split_by_their_marks(spark):
    rnd = random.Random(3)
    bits = ["\\", "#", "##", "###", "####", "</turn>", "<", "</turn", ":", "\n", "a", "### x:\n", "\n</turn>\n", "", "\\### Assistant: </turn> ok"]
    make = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(6)))
    turns = [(c, t, make(), make()) for c in range(120) for t in range(rnd.randrange(1, 4))] + [(-7, 0, "user", bits[-1]), (-7, 1, "assistant", bits[-1])]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    told = defaultdict(str)
    for r in chat.format_conversations(chat.rows_to_events(rows)).orderBy("conv_id", "turn").collect():
        told[r.conv_id] += r.formatted
    for c, text in told.items():
        assert chat.parse_conversation(text) == [(t[2], t[3]) for t in sorted(turns) if t[0] == c]
        with pytest.raises(ValueError):
            chat.parse_conversation(text[:-1])
    reader = chat.TurnReader()
    assert [x for k in range(0, len(told[-7]), 3) for x in reader.feed(told[-7][k : k + 3])] == [("user", bits[-1]), ("assistant", bits[-1])]


def test_sizes_and_laws_of_the_sharding_query(spark):
    """Every row of the table once, its size and checksum, near equal bytes, gapless slots."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()} and len(got) == len(docs)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= 2 * max(len(t.encode()) + 1 for t in docs.values()) + sum(held.values()) / 64
