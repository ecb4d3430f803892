"""Sources, sinks and row-level operators (S*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.domains import normalise_domain
from tidewatch.functions.payload import num, parse_payload, truthy
from tidewatch.functions.times import day_of, normalise_epoch_ms
from tidewatch.operators import predicates as P
from tidewatch.plans.common import ALR, LOG, TEL, with_ctes
from tidewatch.plans.registry import also, query
from tidewatch.session import scratch_dir
from tidewatch.sources import files, messages, tables
from tidewatch.sources.telemetry import alerts, log_lines, table, telemetry


def wire_messages(tel):
    """Telemetry as wire messages: objects and arrays, both key spellings, some broken."""
    row_id = F.col("event_id")
    new_style = row_id % 2 == 0
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.concat(F.when(new_style, '"type":').otherwise('"event_type":'), quote(F.col("event_type")))
    package = F.when(
        F.col("package_name").isNotNull(),
        F.concat(F.when(new_style, ',"packageName":').otherwise(',"package_name":'), quote(F.col("package_name"))),
    ).otherwise("")
    time = F.when(row_id % 41 == 0, "").otherwise(F.concat(F.lit(',"timestamp":'), F.col("ts_ms").cast("string")))
    body = F.concat(F.lit("{"), F.when(row_id % 43 == 0, '"x":1').otherwise(kind), package, time, F.lit(',"data":'), "data", F.lit("}"))
    raw = (
        F.when(row_id % 97 == 0, F.substring(body, 1, 12))
        .when(row_id % 3 == 0, F.concat(F.lit("["), body, F.lit(","), body, F.lit("]")))
        .otherwise(body)
    )
    return tel.select("device_id", row_id.alias("message_id"), raw.alias("raw"))


@query("s1_wire_messages", with_ctes(TEL, """
SELECT device_id, event_id AS message_id, pos::INTEGER AS pos,
  CASE WHEN event_id % 43 = 0 THEN 'UNKNOWN' ELSE event_type END AS event_type, package_name,
  CASE WHEN event_id % 41 = 0 THEN 0 ELSE ts_ms END AS ts_ms, data
FROM tel, (VALUES (0), (1)) AS copies(pos)
WHERE event_id % 97 <> 0 AND (pos = 0 OR event_id % 3 = 0)"""))
def s1(spark, sf_dir):
    return messages.parse_messages(wire_messages(telemetry(spark, sf_dir)))


@query("s2_event_table", with_ctes(TEL, """
SELECT device_id, event_id, event_type, package_name, ts_ms, data, strftime(epoch_ms(ts_ms), '%Y-%m-%d') AS event_day FROM tel"""))
def s2(spark, sf_dir):
    path = scratch_dir(spark, "events")
    tables.write_events(telemetry(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.select("device_id", "event_id", "event_type", "package_name", "ts_ms", "data",
                         F.date_format("event_date", "yyyy-MM-dd").alias("event_day"))


@query("s3_alert_table", with_ctes(ALR, """
SELECT sha256(device_id || '|' || alert_seq || '|rule') AS anomaly_id, device_id, severity, threat_type, created_ms FROM alr"""))
def s3(spark, sf_dir):
    path = scratch_dir(spark, "alerts")
    made = alerts(spark, sf_dir).withColumn("source", F.lit("rule")).withColumn(
        "anomaly_id", tables.alert_id("device_id", "alert_seq", "source")
    )
    tables.append_alerts(made, path)
    tables.append_alerts(made.filter("severity >= 7"), path)  # a replay of part of the batch
    return tables.read_alerts(spark, path).select("anomaly_id", "device_id", "severity", "threat_type", "created_ms")


@query("s4_log_files", with_ctes(LOG, "SELECT line FROM log"))
def s4(spark, sf_dir):
    path = scratch_dir(spark, "logs") + ".log"
    log_lines(spark, sf_dir).select("line").write.text(path)
    return files.read_log_lines(spark, path, "part-*").select("line")


@query("s5_connection_csv", """
SELECT l_orderkey::DOUBLE AS duration, CASE WHEN l_linenumber % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol_type,
  l_quantity AS src_bytes, CASE WHEN l_returnflag = 'N' THEN 'normal' ELSE 'attack' END AS label,
  l_linenumber AS difficulty FROM lineitem""")
def s5(spark, sf_dir):
    path = scratch_dir(spark, "connections")
    rows = table(spark, sf_dir, "lineitem")
    given = {
        "duration": F.col("l_orderkey").cast("double"),
        "protocol_type": F.when(F.col("l_linenumber") % 2 == 0, "tcp").otherwise("udp"),
        "service": F.lit("http"), "flag": F.lit("SF"), "src_bytes": F.col("l_quantity"),
        "label": F.when(F.col("l_returnflag") == "N", "normal").otherwise("attack"), "difficulty": F.col("l_linenumber"),
    }
    names = [part.strip().split(" ")[0].strip("`") for part in files.CONNECTION_DDL.split(",")]
    rows.select(*[given.get(n, F.lit(0.0)).alias(n) for n in names]).write.option("header", False).csv(path)
    return files.read_connections(spark, path).select("duration", "protocol_type", "src_bytes", "label", "difficulty")


@query("s6_labelled_csv", """
SELECT CAST(vec_id AS DOUBLE) AS vec_id, (CASE WHEN label % 2 = 0 THEN 0 ELSE 1 END)::INTEGER AS y FROM embeddings""")
def s6(spark, sf_dir):
    path = scratch_dir(spark, "labelled")
    emb = table(spark, sf_dir, "embeddings")
    emb.select("vec_id", F.when(F.col("label") % 2 == 0, "Benign").otherwise("Malware").alias("Label")).write.option(
        "header", True
    ).csv(path)
    return files.read_labelled(spark, path)


@query("s7_json_artifacts", """
SELECT round(avg(quality), 6) AS w_tabular, 0.30::DOUBLE AS w_text, 0.34::DOUBLE AS t_tabular, round(avg(toxic), 6) AS t_text,
  0.42::DOUBLE AS t_ensemble, 64 AS dims, 64.0::DOUBLE AS trace FROM labels""")
def s7(spark, sf_dir):
    path = scratch_dir(spark, "config")
    table(spark, sf_dir, "labels").agg(
        F.struct(F.round(F.avg("quality"), 6).alias("tabular")).alias("weights"),
        F.struct(F.round(F.avg("toxic"), 6).alias("text")).alias("thresholds"),
    ).write.json(path)
    fallback = tables.stored_baseline(spark, None, 64)
    return tables.ensemble_config(spark, path).select(
        "*", fallback.select(F.size("mean")).scalar().alias("dims"),
        fallback.select(F.expr("aggregate(cov, 0D, (a, x) -> a + x)")).scalar().alias("trace"))


@query("s8_exports", with_ctes(ALR, """
SELECT fmt, anomaly_id, severity, message, confidence FROM alr, (VALUES ('csv'), ('json'), ('parquet')) AS f(fmt)"""))
def s8(spark, sf_dir):
    rows = alerts(spark, sf_dir).select("anomaly_id", "severity", "message", "confidence")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch_dir(spark, f"export-{fmt}")
        tables.export(rows, path, fmt)
        back = tables.load(spark, path, fmt, rows.schema).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


def stored_devices(customers):
    return customers.select(
        F.concat(F.lit("dev_"), F.col("c_custkey").cast("string")).alias("device_id"), F.col("c_name").alias("name"),
        F.lit(0).cast("long").alias("first_seen_ms"), F.lit(1000).cast("long").alias("last_seen_ms"),
        F.lit(False).alias("is_active"),
    )


@query("s10_device_dimension", with_ctes(TEL, """,
old AS (SELECT 'dev_' || c_custkey AS device_id, c_name AS name, 0::BIGINT AS f, 1000::BIGINT AS l FROM customer),
seen AS (SELECT device_id, min(ts_ms) AS f, max(ts_ms) AS l FROM tel GROUP BY ALL)
SELECT device_id, coalesce(old.name, 'Device-' || substr(device_id, 1, 8)) AS name,
  CASE WHEN old.f IS NULL THEN seen.f WHEN seen.f IS NULL THEN old.f ELSE least(old.f, seen.f) END AS first_seen_ms,
  CASE WHEN old.l IS NULL THEN seen.l WHEN seen.l IS NULL THEN old.l ELSE greatest(old.l, seen.l) END AS last_seen_ms,
  seen.l IS NOT NULL AS is_active
FROM old FULL OUTER JOIN seen USING (device_id)"""))
def s10_whole(spark, sf_dir):
    """Every customer is a stored device."""
    return tables.refresh_devices(stored_devices(table(spark, sf_dir, "customer")), telemetry(spark, sf_dir))


also("s10_device_dimension_whole", "s10_device_dimension")


@query("s11_schema_upgrade", with_ctes(TEL, """
SELECT device_id, event_id, event_type, NULL::BIGINT AS last_tz_offset, NULL::VARCHAR AS xai FROM tel WHERE event_id % 2 = 0
UNION ALL SELECT device_id, event_id, event_type, event_id % 3 AS last_tz_offset, 'x' AS xai FROM tel WHERE event_id % 2 = 1"""))
def s11(spark, sf_dir):
    tel = telemetry(spark, sf_dir).select("device_id", "event_id", "event_type")
    path = scratch_dir(spark, "upgrade")
    required = T.StructType([T.StructField("last_tz_offset", T.LongType()), T.StructField("xai", T.StringType())])
    tel.filter("event_id % 2 = 0").write.parquet(f"{path}/v=1")
    tel.filter("event_id % 2 = 1").selectExpr("*", "event_id % 3 AS last_tz_offset", "'x' AS xai").write.parquet(f"{path}/v=2")
    merged = spark.read.option("mergeSchema", True).parquet(path).drop("v")
    return tables.upgrade_schema(merged, required)


@query("p1_ignored_devices", with_ctes(TEL, """
SELECT device_id, count(*) AS n FROM tel
WHERE device_id NOT IN ('dev_0', 'dev_17') AND device_id NOT LIKE 'dev\\_3%' ESCAPE '\\' GROUP BY ALL"""))
def p1(spark, sf_dir):
    kept = P.drop_ignored_devices(telemetry(spark, sf_dir), " DEV_0, dev_17,,", "Dev_3")
    return kept.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))


@query("p2_ignored_packages", with_ctes(TEL, """
SELECT event_id, package_name FROM tel WHERE package_name IS NULL OR package_name NOT IN ('com.app7', 'com.app3')"""))
def p2(spark, sf_dir):
    ignored = spark.createDataFrame([(" Com.App7",), ("com.app3",)], "package_name string")
    return P.drop_ignored_packages(telemetry(spark, sf_dir), ignored).select("event_id", "package_name")


@query("p4_epoch_normalisation", with_ctes(TEL, """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 IN (1, 2, 3) THEN (ts_ms // 1000) * 1000 ELSE ts_ms END AS ts_ms,
  CASE WHEN event_id % 5 <> 4 THEN strftime(epoch_ms(ts_ms), '%Y-%m-%d') END AS day FROM tel"""))
def p4(spark, sf_dir):
    iso = F.date_format(F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ts_ms div 1000)"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.col("ts_ms").cast("string"))
        .when(F.col("event_id") % 5 == 1, F.floor(F.col("ts_ms") / 1000).cast("string"))
        .when(F.col("event_id") % 5 == 2, F.concat(iso, F.lit("Z")))
        .when(F.col("event_id") % 5 == 3, iso)
        .otherwise("yesterday")
    )
    ms = normalise_epoch_ms(text)
    return telemetry(spark, sf_dir).select("event_id", ms.alias("ts_ms"), F.date_format(day_of(ms), "yyyy-MM-dd").alias("day"))


@query("p5_domain_normalisation", """
WITH hosts AS (
  SELECT page_id, url, CASE page_id % 4
    WHEN 0 THEN regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')
    WHEN 1 THEN regexp_replace(split_part(regexp_replace(lower(url), '^[a-z]+://', ''), '/', 1), '^www\\.', '')
    WHEN 2 THEN NULL
    ELSE regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) END AS host
  FROM pages)
SELECT page_id, CASE WHEN regexp_full_match(host, '[a-z0-9][a-z0-9.-]*\\.[a-z]{2,}') THEN host END AS domain FROM hosts""")
def p5(spark, sf_dir):
    url = F.col("url")
    text = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("  "), F.upper(url)))
        .when(F.col("page_id") % 4 == 1, F.regexp_replace(url, "^[a-zA-Z]+://", ""))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("http://10.0.0."), F.col("page_id").cast("string"), F.lit("/x")))
        .otherwise(F.regexp_replace(url, r"^([a-zA-Z]+)://([^/?#]*)", "$1://user@www.$2:8080"))
    )
    return table(spark, sf_dir, "pages").select("page_id", normalise_domain(text).alias("domain"))


@query("p6_payload_columns", with_ctes(TEL, """
SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN try_cast(data->>'$.latency' AS DOUBLE) END AS latency,
  CASE WHEN event_id % 19 <> 0 THEN coalesce(try_cast(data->>'$.rxBytesDelta' AS DOUBLE), 0) ELSE 0 END AS rx,
  CASE WHEN event_id % 19 <> 0 THEN coalesce(data->>'$.lowMemory' = 'true', false) ELSE false END AS low,
  CASE WHEN event_id % 19 <> 0 THEN data->>'$.domain' END AS domain FROM tel"""))
def p6(spark, sf_dir):
    broken = F.when(F.col("event_id") % 38 == 0, F.substring("data", 2, 200)).when(F.col("event_id") % 19 == 0, "[1]").otherwise(F.col("data"))
    df = parse_payload(telemetry(spark, sf_dir).withColumn("data", broken))
    return df.select("event_id", num(F.col("p.latency")).alias("latency"), num(F.col("p.rxBytesDelta"), 0.0).alias("rx"),
                     truthy(F.col("p.lowMemory")).alias("low"), F.col("p.domain").alias("domain"))


@query("p7_quiet_log_lines", with_ctes(LOG, """
SELECT line_no, length(line) AS chars FROM log
WHERE NOT (contains(lower(line), 'avc: denied') OR contains(lower(line), 'auditd') OR contains(lower(line), 'bpf')
           OR contains(lower(line), 'thermal')) AND contains(lower(line), 'a')"""))
def p7(spark, sf_dir):
    kept = P.quiet_lines(log_lines(spark, sf_dir), package_filter=" A ")
    return kept.select("line_no", F.length("line").cast("long").alias("chars"))


@query("p8_system_and_side_loaded", with_ctes(TEL, """
SELECT event_id, package_name LIKE 'com.android.%' AS system_app,
  CASE event_id % 3 WHEN 0 THEN false ELSE true END AS side_loaded
FROM tel WHERE package_name IS NOT NULL"""))
def p8(spark, sf_dir):
    installer = F.when(F.col("event_id") % 3 == 0, "com.android.vending").when(F.col("event_id") % 3 == 1, " ")
    tel = telemetry(spark, sf_dir).filter("package_name IS NOT NULL")
    return tel.select("event_id", P.is_system_package(F.col("package_name")).alias("system_app"),
                      P.is_side_loaded(installer).alias("side_loaded"))


@query("p9_event_severity", with_ctes(TEL, """
SELECT event_id, (CASE WHEN event_id % 7 = 0 THEN greatest(1, least(10, event_id % 15 - 2))
  WHEN event_type LIKE 'SECURITY%' THEN 7 WHEN event_type LIKE 'NETWORK_FLOW%' THEN 6 WHEN event_type LIKE 'NETWORK%' THEN 5
  WHEN event_type LIKE 'SYSTEM%' THEN 4 ELSE 2 END)::INTEGER AS score FROM tel"""))
def p9(spark, sf_dir):
    explicit = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 15 - 2)
    return telemetry(spark, sf_dir).select("event_id", P.event_severity(F.col("event_type"), explicit).alias("score"))


@query("p10_severity_label", with_ctes(ALR, """
SELECT severity, CASE WHEN severity >= 9 THEN 'critical' WHEN severity >= 7 THEN 'high' WHEN severity >= 4 THEN 'medium' ELSE 'low' END
  AS label, count(*) AS n FROM alr GROUP BY ALL"""))
def p10(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("severity", P.severity_label(F.col("severity")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_auth_failures", with_ctes(TEL, """
SELECT event_id FROM tel WHERE event_type = 'SECURITY_AUTH_EVENT' AND data->>'$.event' = 'AUTH_FAIL'"""))
def p11(spark, sf_dir):
    return telemetry(spark, sf_dir).filter(P.is_auth_failure(F.col("event_type"), F.col("data"))).select("event_id")


_IOC_SQL = """CASE WHEN starts_with(indicator, 'app:') THEN 'app' WHEN starts_with(indicator, 'domain:') THEN 'domain'
    WHEN starts_with(indicator, 'phishing:') THEN 'phishing' WHEN starts_with(indicator, 'perm:') THEN 'permission'
    WHEN threat_type = 'PHISHING' THEN 'phishing' WHEN message LIKE 'Known malicious app%' THEN 'app'
    WHEN message LIKE 'Known malicious website%' THEN 'domain'
    WHEN message LIKE 'permission use: %' AND (message LIKE '%camera%' OR message LIKE '%location%') THEN 'permission' END"""


@query("p12_ioc_class", with_ctes(ALR, f"SELECT anomaly_id, {_IOC_SQL} AS ioc_type FROM alr"))
def p12(spark, sf_dir):
    return classed_alerts(spark, sf_dir).select("anomaly_id", "ioc_type")


def classed_alerts(spark, sf_dir, since_ms=None):
    return alerts(spark, sf_dir, since_ms).withColumn("ioc_type", P.ioc_class(F.col("indicator"), F.col("threat_type"), F.col("message")))


@query("p13_ioc_feed", with_ctes(ALR + f", c AS (SELECT *, {_IOC_SQL} AS ioc_type FROM alr)", """
SELECT 'all' AS mode, anomaly_id FROM c UNION ALL SELECT 'ioc', anomaly_id FROM c WHERE ioc_type IN ('app','domain')
UNION ALL SELECT 'ioc-app', anomaly_id FROM c WHERE ioc_type = 'app' UNION ALL SELECT 'ioc-domain', anomaly_id FROM c WHERE ioc_type = 'domain'"""))
def p13(spark, sf_dir):
    feed = classed_alerts(spark, sf_dir)
    return feed.select(F.explode(P.ioc_modes(F.col("ioc_type"))).alias("mode"), "anomaly_id")


@query("p14_payload_preview", """
SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'No payload' ELSE substr(text, 1, 180) END AS preview FROM documents""")
def p14(spark, sf_dir):
    text = F.when(F.col("doc_id") % 46 == 0, "").when(F.col("doc_id") % 23 != 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", P.payload_preview(text).alias("preview"))


@query("p15_weak_label", with_ctes(LOG, """
SELECT line_no, (CASE WHEN (['V','D','I','W','E','F','A'])[line_no % 7 + 1] IN ('W','E','F') THEN 1 ELSE 0 END)::INTEGER AS weak_label
FROM log WHERE line_no % 50 <> 25 AND line_no % 17 <> 5 AND line_no % 7 <> 6"""))
def p15(spark, sf_dir):
    from tidewatch.operators.logs import parse_training_lines

    parsed = parse_training_lines(log_lines(spark, sf_dir))
    return parsed.select("line_no", P.weak_label(F.col("level")).alias("weak_label"))
