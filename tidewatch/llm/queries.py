"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontaminate, exact_dedup, language, mixing, neighbours, ngram_join, secrets, sharding, spelling, toxicity, warc, whitening
from tidewatch.llm.common import share_of_id, table
from tidewatch.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard_documents(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


MIX_SEED = 4


@query(
    "op4_mixing",
    f"""
    WITH d AS (
      SELECT doc_id, source,
             CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) AS weight,
                 3.0::DOUBLE * source_size AS bound FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
    c AS (SELECT min(level) AS common FROM l WHERE bound >= level * weight
            AND bound / weight = (SELECT min(bound / weight) FROM l WHERE bound >= level * weight)),
    t AS (SELECT source, source_size,
                 CASE WHEN common IS NULL THEN bound ELSE least(bound, common * weight) END AS target
          FROM l, c),
    r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
                 row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS place
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(least(floor(place * rate + {mixing.offset(MIX_SEED)!r}::DOUBLE)
                      - floor((place - 1) * rate + {mixing.offset(MIX_SEED)!r}::DOUBLE), 3) AS BIGINT) * size AS taken
    FROM r""",
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), seed=MIX_SEED).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


@query(
    "op5_exact_dedup",
    """
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM d JOIN g USING (body)""",
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    """Pieces and matches of each rule alternate, as in the operator; lists stand for the arrays."""
    parts = []
    for n, rule in enumerate(secrets.RULES):
        # RE2 would fold letters beyond ASCII, so either case is spelt out.
        keys = "password|passwd|secret|token|api_?key"
        both = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in keys)
        pattern = rule.pattern.replace(f"(?i:{keys})", f"(?:{both})").replace("((?:", "((?:").replace("'", "''")
        parts.append(f"""
          SELECT doc_id, {n} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
                 regexp_split_to_array(body, '{pattern}') AS skip, regexp_extract_all(body, '{pattern}', 0) AS hit,
                 regexp_extract_all(body, '{pattern}', {rule.group}) AS val, {rule.least} AS least
          FROM d WHERE regexp_matches(body, '{pattern}')""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    i AS (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM m),
    p AS (SELECT doc_id, rank, kind, base, length(val[k]) >= least AS good,
                 CAST(list_sum([length(x) FOR x IN skip[1:k]]) + coalesce(list_sum([length(x) FOR x IN hit[1:k-1]]), 0) AS BIGINT) AS s,
                 length(hit[k]) AS n FROM i),
    q AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
                 count(*) FILTER (kind = 'hex') AS h,
                 string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (base) AS b,
                 string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS t
          FROM p WHERE good GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(t, '') AS spans
    FROM d LEFT JOIN q USING (doc_id)"""


@query("op6_secret_scan", _secret_sql())
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query(
    "op9_ngram_join",
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS v FROM d),
    n AS (SELECT doc_id, CAST(len(v) AS BIGINT) AS n FROM s),
    i AS (SELECT doc_id, unnest(v) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM i a JOIN i b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
          WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
    SELECT node AS doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id
    FROM r JOIN n ON n.doc_id = r.node GROUP BY node""",
)
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(share_of_id("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")
    held = F.coalesce(share_of_id("doc_id", 4) == 2, F.lit(False))
    found = language.identify_language(docs.select("doc_id", held.alias("held_out"), "text"), language.train(known), keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label) of the labels that may be learned from."""
    labels = table(spark, sf_dir, "labels").filter(share_of_id("doc_id", 5) != 0)
    return labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.select(F.col("doc_id").alias("id"), "text"), toxic_labels(spark, sf_dir))
    held = F.coalesce(share_of_id("doc_id", 5) == 0, F.lit(False))
    found = toxicity.score_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model, keep_text=False)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ESCAPED = "regexp_replace({}, '(\\\\|###|</turn>{})', '\\\\\\1', 'g')"
_TRICKY = "\\### Assistant: </turn> ok"


@query(
    "op3_chat_format",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(15 + length({_ESCAPED.format("role", "|:")}) + length({_ESCAPED.format("text", "")})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id""",
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(chat.rows_to_events(rows)))


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
    f AS (SELECT body, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY body)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
           CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN f ON f.body = p.body AND p.n >= 1000""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    # Two reads, told apart by a header: revisits need no payload, so theirs are stepped over.
    fields = ["record_type", "page_id", "refers_to", "payload_digest", "payload_length"]
    full = warc.read_warc(spark, path, ["record_type", "page_id", "payload"], verify=True).filter(F.col("record_type") == "response").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    again = warc.read_warc(spark, path, fields).filter(F.col("record_type") == "revisit").select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
    )
    return full.unionByName(again)


def _crc32(value: str) -> str:
    """DuckDB: the crc32 of a string's UTF-8 bytes, byte by byte."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    octets = f"[('0x' || substr(hex(encode({value})), 2 * k - 1, 2))::BIGINT FOR k IN range(1, strlen({value}) + 1)]"
    step = f"xor(c >> 8, ({table})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


@query(
    "op13_spelling_variants",
    f"""
    WITH RECURSIVE t AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents),
    l AS (SELECT id, translate(raw, '{spelling.UPPER}', '{spelling.UPPER.lower()}') AS run, count(*) AS k FROM t WHERE length(raw) >= 6 GROUP BY ALL),
    h AS (SELECT run, k, {_crc32("id || ':' || run")} AS h FROM l),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h),
    v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    -- Words one edit apart share what is left of them without one letter at one place, or one is such a rest of the other.
    g AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) u(p)),
    e AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM g a JOIN v b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM g a JOIN v b ON a.rest = b.word),
    b AS (SELECT word, count(*) AS near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM e GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form,
                 CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
    r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word)""",
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), typo=199)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=32)


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
