"""All that the adaptive detector is told about a window, for the batch flow and the stream alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.payload import parse_payload
from tidewatch.operators import alerts as AL
from tidewatch.operators import features as X
from tidewatch.operators import rules as R

KEY = ["device_id", "window_id"]
#: The feature groups of the vector, in order.
GROUPS = ["f_hours", "f_freq", "f_entropy", "f_transitions", "f_keys", "f_touch", "f_swipe", "f_combined"]


def detector_inputs(
    wins: DataFrame, bad_apps: Sequence[str] = (), bad_domains: Sequence[str] = (), ignored_packages: Sequence[str] = (),
    scores: DataFrame | None = None, slopes: DataFrame | None = None,
) -> DataFrame:
    """One row per window of ``wins`` (events with device_id, window_id, pos): end_ms, n, vector, mask, tz_offset; the rule alert as ``rule``
    and as the flat fields that the detector reads; sensitive; tabular_prob and text_prob of ``scores`` (per window); slope of ``slopes`` (per device).
    """
    vectors = X.feature_groups(wins).select(
        *KEY, F.expr("element_at(ev, -1).ts_ms").alias("end_ms"), F.size("ev").alias("n"), F.concat(*GROUPS).alias("vector"), "mask",
        F.expr("get(filter(transform(ev, e -> e.tz), t -> t IS NOT NULL), 0)").alias("tz_offset"))
    found = R.rule_alerts(wins, bad_apps, bad_domains, ignored_packages)
    rule = found.select(*KEY, F.struct("severity", "threat_type", "message", "confidence", "indicator", "target_package").alias("rule"))
    asked = parse_payload(wins.filter(F.upper("event_type") == "PERMISSION_ACCESS"))
    sensitive = asked.filter(F.upper("p.permission").isin(*AL.SENSITIVE)).select(*KEY).distinct().withColumn("sensitive", F.lit(True))
    out = vectors.join(rule, KEY, "left").join(sensitive, KEY, "left")
    none = F.lit(None).cast("double")
    if scores is None:
        out = out.withColumns({"tabular_prob": none, "text_prob": none})
    else:
        out = out.join(scores.select(*KEY, "tabular_prob", "text_prob"), KEY, "left")
    out = out.withColumn("slope", none) if slopes is None else out.join(slopes.select("device_id", "slope"), "device_id", "left")
    return out.select(
        *KEY, "end_ms", "n", "vector", "mask", "tz_offset", "rule", F.col("rule").isNotNull().alias("rule_hit"), F.col("rule.indicator").alias("rule_indicator"),
        F.col("rule.threat_type").alias("rule_threat"), F.col("rule.severity").cast("int").alias("rule_severity"),
        F.coalesce("sensitive", F.lit(False)).alias("sensitive"), "tabular_prob", "text_prob", "slope",
    )
