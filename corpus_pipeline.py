"""From raw documents to a sharded training mix. Counted as part of the subpackage llm.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from tidewatch.llm.common import private, table, without
from tidewatch.llm.queries import toxic_labels
from tidewatch.session import materialise


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. The model is fitted on the labelled rows that are not held out."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    model = toxicity.train(texts, toxic_labels(spark, sf_dir))
    (score,) = private(docs, "score")
    return without(toxicity.score_toxicity(docs, model, score_col=score).filter(F.col(score) < 0.5), [score])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the document with the smallest id."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of the sources draws it."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in eight shards of near equal bytes, with the place of each row in its shard."""
    return sharding.shard_documents(docs, shards=8)


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("decontamination", leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage is a fitted classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written once to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
