"""Federated model rounds as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.settings import FL_MAX_DIM, FL_MAX_NORM, FL_MIN_UPDATES


def check_updates(
    updates: DataFrame, clients: DataFrame, current_round: int, model_version: int, model_dim: int, max_dim: int = FL_MAX_DIM
) -> DataFrame:
    """Adds ``reason``: null for an accepted update, else the first check that failed."""
    known = clients.select("client_id", F.lit(True).alias("_known")).distinct()
    size = F.size("weights_delta")
    reason = (
        F.when(F.trim(F.coalesce("client_id", F.lit(""))) == "", "client_id is required")
        .when(size <= 0, "weights_delta must not be empty")
        .when(size > max_dim, f"weights_delta length exceeds max {max_dim}")
        .when(F.col("_known").isNull(), "client_id is not registered")
        .when(F.col("round_id") != current_round, "round_id does not match current round")
        .when(F.col("base_model_version") != model_version, "base_model_version does not match latest global model version")
        .when((F.lit(model_dim) > 0) & (size != model_dim), "weights_delta length does not match global model dimensions")
    )
    return updates.join(known, "client_id", "left").withColumn("reason", reason).drop("_known")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def round_deltas(updates: DataFrame, max_norm: float = FL_MAX_NORM) -> DataFrame:
    """Sample-weighted mean delta per round and dimension, scaled down to ``max_norm``.

    Updates whose length differs from the first one of the round do not take part.
    """
    weight = F.greatest(F.lit(1), F.col("num_samples"))
    first = updates.groupBy("round_id").agg(F.min_by(F.size("weights_delta"), "client_id").alias("_dim"))
    same = updates.join(first, "round_id").filter(F.size("weights_delta") == F.col("_dim"))
    long = same.select("round_id", weight.alias("n"), F.posexplode("weights_delta").alias("dim", "d"))
    mean = long.groupBy("round_id", "dim").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("delta"), F.count(F.lit(1)).alias("n_updates"))
    norm = mean.groupBy("round_id").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("norm"))
    scale = F.when(F.col("norm") > max_norm, F.lit(max_norm) / F.col("norm")).otherwise(1.0)
    return mean.join(norm, "round_id").withColumn("delta", F.col("delta") * scale)


def close_rounds(
    updates: DataFrame, model: DataFrame, min_updates: int = FL_MIN_UPDATES, force: bool = False, max_norm: float = FL_MAX_NORM
) -> DataFrame:
    """New global weights per round, or ``waiting`` where too few updates came in.

    ``model`` has ``round_id``, ``version`` and ``weights`` (null or empty starts at zeros).
    """
    counts = updates.groupBy("round_id").agg(F.count(F.lit(1)).alias("pending"))
    ready = counts.filter(F.lit(force) | (F.col("pending") >= min_updates))
    deltas = round_deltas(updates.join(ready.select("round_id"), "round_id", "left_semi"), max_norm)
    vector = deltas.groupBy("round_id").agg(
        F.expr("transform(array_sort(collect_list(struct(dim, delta))), x -> x.delta)").alias("_delta"),
        F.max("n_updates").alias("aggregated_updates"),
    )
    weights = F.when(F.coalesce(F.size("weights"), F.lit(0)) <= 0, F.col("_delta")).otherwise(
        F.zip_with("weights", "_delta", lambda w, d: w + d)
    )
    return (
        counts.join(vector, "round_id", "left").join(model, "round_id", "left")
        .select(
            "round_id", "pending",
            F.when(F.col("_delta").isNotNull(), "aggregated").otherwise("waiting").alias("status"),
            F.coalesce("aggregated_updates", F.lit(0)).alias("aggregated_updates"),
            F.when(F.col("_delta").isNotNull(), F.col("version") + 1).otherwise(F.col("version")).alias("version"),
            F.when(F.col("_delta").isNotNull(), F.col("round_id") + 1).otherwise(F.col("round_id")).alias("next_round_id"),
            F.when(F.col("_delta").isNotNull(), weights).otherwise(F.col("weights")).alias("weights"),
        )
    )


def federation_status(updates: DataFrame, clients: DataFrame) -> DataFrame:
    """Pending updates per round with the number of registered clients and the dimension."""
    n_clients = clients.agg(F.count_distinct("client_id").alias("n"))
    pending = updates.groupBy("round_id").agg(F.count(F.lit(1)).alias("pending"), F.max(F.size("weights_delta")).alias("weights_dim"))
    return pending.select("*", F.coalesce(n_clients.scalar(), F.lit(0)).alias("registered_clients"))


def drop_stale_clients(clients: DataFrame, as_of_ms: int, days: int = 7) -> DataFrame:
    """Keeps clients seen within ``days``; a date that cannot be read counts as stale."""
    from tidewatch.functions.times import DAY_MS, normalise_epoch_ms

    seen = normalise_epoch_ms(F.col("last_seen"))
    return clients.filter(F.coalesce(seen >= as_of_ms - days * DAY_MS, F.lit(False)))
