"""Model evaluation and federated rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators import federated as FL
from tidewatch.plans.common import with_ctes
from tidewatch.plans.registry import also, query
from tidewatch.sources.telemetry import table


def scored(spark, sf_dir, label="quality"):
    """Labelled documents with a score made from their length, id as key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = ((F.col("n_chars") * 7 + F.col("doc_id") * 3) % 101) / 100.0
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col(label).alias("label"), score.alias("score"))


def _sc(label="quality", name="sc"):
    return f"""{name} AS (SELECT doc_id AS id, {label} AS label, ((n_chars * 7 + doc_id * 3) % 101) / 100.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"""


def _rates(source: str) -> str:
    return f"""(SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision",
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score,
    CASE WHEN tp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END AS f2_score FROM {source})"""


_SHOW = ", ".join(f'round("{c}", 9)::DOUBLE AS "{c}"' for c in ("accuracy", "precision", "recall", "f1_score", "f2_score"))
RATES = ["accuracy", "precision", "recall", "f1_score", "f2_score"]


def _rounded(df):
    for c in RATES:
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 9))
    return df


def _conf(name, threshold, scores="sc"):
    return f"""{name} AS (SELECT count(*) FILTER (score >= {threshold} AND label = 1) AS tp, count(*) FILTER (score >= {threshold} AND label <> 1) AS fp,
  count(*) FILTER (score < {threshold} AND label <> 1) AS tn, count(*) FILTER (score < {threshold} AND label = 1) AS fn FROM {scores})"""


@query("a23_confusion_metrics", with_ctes(_sc() + "," + _conf("cm", 0.5), f"SELECT tp, fp, tn, fn, {_SHOW} FROM {_rates('cm')}"))
def a23(spark, sf_dir):
    return _rounded(E.confusion(scored(spark, sf_dir), 0.5))


@query("a24_roc_auc", with_ctes(_sc(), """
SELECT (SELECT count(*) FROM sc WHERE label = 1) AS positives, (SELECT count(*) FROM sc WHERE label <> 1) AS negatives,
  round((SELECT avg(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM sc p, sc n WHERE p.label = 1 AND n.label <> 1), 9) AS roc_auc"""))
def a24(spark, sf_dir):
    return E.roc_auc(scored(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 9))


def _grid(name="grid", scores="sc"):
    rows = ", ".join(f"({t!r}::DOUBLE)" for t in E.GRID)
    return f"""{name} AS (SELECT t AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label <> 1) AS fp,
  count(*) FILTER (score < t AND label <> 1) AS tn, count(*) FILTER (score < t AND label = 1) AS fn FROM {scores}, (VALUES {rows}) AS g(t) GROUP BY t)"""


@query("j10_threshold_grid", with_ctes(_sc() + "," + _grid(), f"SELECT threshold, tp, fp, tn, fn, {_SHOW} FROM {_rates('grid')}"))
def j10(spark, sf_dir):
    return _rounded(E.threshold_grid(scored(spark, sf_dir)))


def _tuned(name, floor, grid="grid"):
    return f"""{name} AS (SELECT threshold, "precision", recall, f1_score, f2_score,
  CASE WHEN ok THEN 'max recall with precision >= {floor:.2f}' ELSE 'fallback to best F2 score (precision floor unmet)' END AS selection_reason
  FROM (SELECT *, "precision" >= {floor} AS ok FROM {_rates(grid)}) ORDER BY ok DESC, CASE WHEN ok THEN recall END DESC, f2_score DESC, threshold LIMIT 1)"""


_TSHOW = ", ".join(f'round("{c}", 9)::DOUBLE AS "{c}"' for c in ("precision", "recall", "f1_score", "f2_score"))


@query("m7_tuned_threshold", with_ctes(
    ",".join([_sc(), _grid(), _tuned("t1", 0.8), _tuned("t2", 0.5), _tuned("t3", 0.999)]),
    " UNION ALL ".join(f"SELECT {f}::DOUBLE AS floor, threshold, {_TSHOW}, selection_reason FROM {t}" for f, t in ((0.8, "t1"), (0.5, "t2"), (0.999, "t3")))))
def m7(spark, sf_dir):
    out = None
    for floor in (0.8, 0.5, 0.999):
        row = _rounded(E.tuned_threshold(scored(spark, sf_dir), floor)).select(F.lit(floor).alias("floor"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("m5_balanced_weights", with_ctes(_sc(), """
SELECT id, label, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM sc) * count(*) OVER (PARTITION BY label)), 9) AS weight FROM sc"""))
def m5(spark, sf_dir):
    return E.balanced_weights(scored(spark, sf_dir)).select("id", "label", F.round("weight", 9).alias("weight"))


_SPLIT = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(id::VARCHAR), 1, 12))::BIGINT, id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM sc),
split AS (SELECT id, label, score, rn < round_even(n * 0.2::DOUBLE, 0) AS is_test FROM ranked)"""


@query("m6_stratified_split", with_ctes(_sc() + _SPLIT, "SELECT id, label, is_test FROM split"))
def m6(spark, sf_dir):
    return E.stratified_split(scored(spark, sf_dir), "id").select("id", "label", "is_test")


@query("a26_split_report", with_ctes(_sc() + _SPLIT, "SELECT is_test, count(*) AS n, round(avg(label), 9) AS positive_ratio FROM split GROUP BY ALL"))
def a26(spark, sf_dir):
    return E.split_report(E.stratified_split(scored(spark, sf_dir), "id")).withColumn("positive_ratio", F.round("positive_ratio", 9))


@query("m8_ensemble_settings", with_ctes(
    ",".join([_sc(), _sc("toxic", "st"), _grid(), _grid("gridt", "st"), _tuned("ta", 0.8), _tuned("tb", 0.65, "gridt")]), """
, w AS (SELECT round_even(greatest(0.55, least(ta."precision" / greatest(ta."precision" + tb."precision", 1e-6), 0.85)), 3)::DOUBLE AS w, ta.threshold AS a, tb.threshold AS b, (ta.recall + tb.recall) / 2 AS r FROM ta, tb)
SELECT w AS w_tabular, round(1 - w, 3)::DOUBLE AS w_text, a AS t_tabular, b AS t_text, CASE WHEN r >= 0.75 THEN 0.42 ELSE 0.38 END::DOUBLE AS t_ensemble FROM w"""))
def m8(spark, sf_dir):
    a = E.tuned_threshold(scored(spark, sf_dir), 0.8)
    b = E.tuned_threshold(scored(spark, sf_dir, "toxic"), 0.65)
    return E.ensemble_settings(a, b)


def updates(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    shaped = F.when(F.col("vec_id") % 31 == 0, F.slice(vector, 1, 10)).when(F.col("vec_id") % 37 == 0, F.slice(vector, 1, 0)).otherwise(vector)
    return emb.select(
        F.when(F.col("vec_id") % 41 != 0, F.concat(F.lit("c"), F.col("vec_id").cast("string"))).otherwise(" ").alias("client_id"),
        "vec_id", F.col("label").alias("round_id"), F.when(F.col("vec_id") % 20 == 0, 2).otherwise(1).alias("base_model_version"),
        (F.col("vec_id") % 50 + 1).alias("num_samples"), shaped.alias("weights_delta"),
    )


def registered(emb):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int")), "yyyy-MM-dd")
    seen = F.when(F.col("vec_id") % 11 == 0, "soon").when(F.col("vec_id") % 2 == 0, F.concat(day, F.lit("T12:00:00+00:00"))).otherwise(F.concat(day, F.lit("T12:00:00")))
    return emb.select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("client_id"), "vec_id", seen.alias("last_seen"))


@query("j6_update_validation", """
SELECT vec_id, CASE WHEN vec_id % 41 = 0 THEN 'client_id is required' WHEN vec_id % 31 <> 0 AND vec_id % 37 = 0 THEN 'weights_delta must not be empty'
  WHEN 'c' || vec_id NOT IN (SELECT 'c' || c_custkey FROM customer) THEN 'client_id is not registered' WHEN label <> 3 THEN 'round_id does not match current round'
  WHEN vec_id % 20 = 0 THEN 'base_model_version does not match latest global model version'
  WHEN vec_id % 31 = 0 THEN 'weights_delta length does not match global model dimensions' END AS reason FROM embeddings""")
def j6_whole(spark, sf_dir):
    """Customers are the registered clients; vectors beyond their ids are updates of unknown ones."""
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("client_id"))
    checked = FL.check_updates(updates(spark, sf_dir), known, current_round=3, model_version=1, model_dim=64)
    return checked.select("vec_id", "reason")


also("j6_update_validation_whole", "j6_update_validation")


_FL = """
u AS (SELECT vec_id, label AS round_id, 1 + vec_id % 50 AS n, unnest(embedding)::DOUBLE AS d, unnest(range(64)) AS dim FROM embeddings),
m AS (SELECT round_id, dim, sum(n * d) / sum(n) AS delta, count(*) AS k FROM u GROUP BY ALL),
c AS (SELECT *, sqrt(sum(delta * delta) OVER (PARTITION BY round_id)) AS norm FROM m)"""


@query("a21_round_aggregation", with_ctes(_FL, """
SELECT round_id, 'aggregated' AS status, k AS aggregated_updates, 8::BIGINT AS version, round_id + 1 AS next_round_id, dim::INTEGER AS dim,
  round(dim / 100.0::DOUBLE + delta * least(1, 0.2 / norm), 6) AS weight FROM c"""))
def a21(spark, sf_dir):
    ups = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("client_id"), F.col("label").alias("round_id"),
        (F.col("vec_id") % 50 + 1).alias("num_samples"), F.transform("embedding", lambda x: x.cast("double")).alias("weights_delta"),
    )
    model = table(spark, sf_dir, "embeddings").select(F.col("label").alias("round_id")).distinct().select(
        "round_id", F.lit(7).cast("long").alias("version"), F.expr("transform(sequence(0, 63), i -> i / 100D)").alias("weights"))
    closed = FL.close_rounds(ups, model, max_norm=0.2)
    return closed.select("round_id", "status", "aggregated_updates", "version", "next_round_id", F.posexplode("weights").alias("dim", "weight")).withColumn(
        "weight", F.round("weight", 6))


@query("a22_federation_status", """
SELECT label AS round_id, count(*) AS pending, 64 AS weights_dim, (SELECT count(*) FROM embeddings) AS registered_clients FROM embeddings GROUP BY ALL""")
def a22_whole(spark, sf_dir):
    return FL.federation_status(updates(spark, sf_dir), registered(table(spark, sf_dir, "embeddings")))


also("a22_federation_status_whole", "a22_federation_status")


@query("r9_stale_clients", """
SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 30 >= 23""")
def r9_whole(spark, sf_dir):
    return FL.drop_stale_clients(registered(table(spark, sf_dir, "embeddings")), 1706659200000).select("vec_id")


also("r9_stale_clients_whole", "r9_stale_clients")
