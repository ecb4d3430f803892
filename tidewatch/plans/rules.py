"""Rules, indicator joins, cooldowns and phishing (A6, J2-J5, D15-D20, R3, H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import phishing as H
from tidewatch.operators import rules as R
from tidewatch.operators.predicates import drop_ignored_devices
from tidewatch.functions.domains import normalise_domain
from tidewatch.functions.payload import parse_payload
from tidewatch.operators.windows import count_windows
from tidewatch.plans.common import TEL, WIN, with_ctes, with_recursive
from tidewatch.plans.registry import query
from tidewatch.session import materialise
from tidewatch.settings import (
    BRANDS, DNS_BLOCKLIST, OFFICIAL_DOMAINS, PHISHING_PATTERNS, SUSPICIOUS_KEYWORDS, SUSPICIOUS_TLDS, URL_PATH_KEYWORDS,
)
from tidewatch.sources.telemetry import table, telemetry

BAD_APPS = ["com.app11"]
BAD_DOMAINS = ["phishing.test", "free-prize-winner.buzz"]
IGNORED = ["com.app7"]

# Rule inputs per window; events that name only ignored packages do not count.
_RULES = """,
e AS (SELECT *, coalesce(package_name, '') = 'com.app7' AS skip,
  CASE WHEN event_type IN ('NETWORK_APP','NETWORK_TRAFFIC') THEN CAST(data->>'$.rxBytesDelta' AS DOUBLE) + CAST(data->>'$.txBytesDelta' AS DOUBLE)
       WHEN event_type = 'NETWORK_FLOW' THEN CAST(data->>'$.bytes' AS DOUBLE) ELSE 0 END AS b,
  CASE WHEN event_type = 'WEB_DOMAIN' THEN data->>'$.domain' END AS dom FROM win),
cnt AS (SELECT device_id, window_id, count(*) AS n, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
  count(*) FILTER (NOT skip AND event_type = 'SECURITY_PACKAGE_EVENT') AS package_events,
  count(*) FILTER (NOT skip AND event_type = 'SECURITY_AUTH_EVENT') AS auth_events,
  count(*) FILTER (NOT skip AND data->>'$.lowMemory' = 'true') AS low_memory_events,
  count(*) FILTER (NOT skip AND try_cast(data->>'$.batteryPct' AS INT) <= 10) AS battery_critical_events,
  count(*) FILTER (NOT skip AND event_type LIKE 'NETWORK%') AS flow_events,
  coalesce(sum(b) FILTER (NOT skip), 0) / 1048576 AS network_mb FROM e GROUP BY ALL)"""

_PERM = """
  CASE WHEN data->>'$.isSideLoaded' = 'true' THEN CASE WHEN data->>'$.permission' IN ('CAMERA','RECORD_AUDIO') THEN 8 ELSE 7 END
       WHEN data->>'$.permission' IN ('CAMERA','RECORD_AUDIO') THEN 5 END"""

_CAND = """,
cand AS (
  SELECT device_id, window_id, 9 AS severity, 10 AS rank, 0 AS pos, 'MALWARE_MIMICRY' AS threat_type,
    'Known malicious app activity detected: com.app11' AS message, 0.97 AS confidence, 'app:com.app11' AS indicator, 'com.app11' AS target_package
  FROM (SELECT DISTINCT device_id, window_id FROM e WHERE package_name = 'com.app11')
  UNION ALL SELECT device_id, window_id, 8, 20, 0, 'MALWARE_MIMICRY', 'Known malicious website detected: ' || max(dom), 0.94, 'domain:' || max(dom), NULL
  FROM e WHERE dom IN ('phishing.test', 'free-prize-winner.buzz') OR dom LIKE '%.phishing.test' OR dom LIKE '%.free-prize-winner.buzz' GROUP BY 1, 2
  UNION ALL SELECT device_id, window_id, least(9, 6 + package_events), 30, 0, 'INSIDER_THREAT',
    package_events || ' app package modifications detected in one analysis window', least(0.95, 0.7 + package_events * 0.05), NULL, NULL FROM cnt WHERE package_events >= 2
  UNION ALL SELECT device_id, window_id, 7, 40, 0, 'INSIDER_THREAT', 'Unusual authentication/screen churn detected (' || auth_events || ' events)', 0.8, NULL, NULL
  FROM cnt WHERE auth_events >= 15
  UNION ALL SELECT device_id, window_id, 8, 50, 0, 'DEVICE_MISUSE', printf('High network burst (%.1f MB) during system stress (low_memory=%d, battery_critical=%d)',
    network_mb, low_memory_events, battery_critical_events), 0.85, NULL, NULL
  FROM cnt WHERE network_mb >= 25 AND (low_memory_events > 0 OR battery_critical_events > 0)
  UNION ALL SELECT device_id, window_id, 7, 60, 0, 'DEVICE_MISUSE', 'Dense network flow burst detected (' || flow_events || ' flow events)', 0.8, NULL, NULL
  FROM cnt WHERE flow_events >= 30 AND network_mb >= 10
  UNION ALL SELECT device_id, window_id, sev, 70, pos, CASE WHEN sev = 8 THEN 'INSIDER_THREAT' ELSE 'DEVICE_MISUSE' END,
    CASE sev WHEN 8 THEN 'Side-loaded app ''' || pkg || ''' accessed ' || replace(lower(perm), '_', ' ') || ' — potential surveillance risk'
             WHEN 7 THEN 'Side-loaded app ''' || pkg || ''' accessed location data'
             ELSE 'Third-party app ''' || pkg || ''' accessed ' || replace(lower(perm), '_', ' ') END,
    CASE sev WHEN 8 THEN 0.9 WHEN 7 THEN 0.85 ELSE 0.65 END, CASE WHEN sev > 5 THEN 'perm:' || pkg || ':' || perm END, CASE WHEN sev > 5 THEN pkg END
  FROM (SELECT *, """ + _PERM + """ AS sev, data->>'$.packageName' AS pkg, data->>'$.permission' AS perm FROM e WHERE event_type = 'PERMISSION_ACCESS') WHERE sev IS NOT NULL),
rule AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY device_id, window_id ORDER BY severity DESC, rank DESC, pos DESC) = 1)"""
RULE_CTES = WIN + _RULES + _CAND


@query("a6_rule_counters", with_ctes(WIN + _RULES, """
SELECT device_id, window_id, package_events, auth_events, low_memory_events, battery_critical_events, flow_events, round(network_mb, 6) AS network_mb FROM cnt"""))
def a6(spark, sf_dir):
    return R.rule_counters(count_windows(telemetry(spark, sf_dir)), IGNORED).withColumn("network_mb", F.round("network_mb", 6))


@query("d15_rule_arbitration", with_ctes(RULE_CTES, """
SELECT device_id, window_id, cnt.n, start_ms, end_ms, severity::INTEGER AS severity, threat_type, message, round(confidence, 6)::DOUBLE AS confidence, indicator, target_package
FROM rule JOIN cnt USING (device_id, window_id) WHERE device_id <> 'dev_0'"""))
def d15(spark, sf_dir):
    kept = drop_ignored_devices(telemetry(spark, sf_dir), "dev_0")
    out = R.rule_alerts(count_windows(kept), BAD_APPS, BAD_DOMAINS, IGNORED)
    return out.withColumn("confidence", F.round("confidence", 6)).orderBy(F.desc("severity"), "device_id", "window_id")


@query("j2_bad_app_join", with_ctes(WIN, """
SELECT DISTINCT device_id, window_id, package_name FROM win WHERE package_name IN ('com.app11', 'com.app5')"""))
def j2(spark, sf_dir):
    bad = spark.createDataFrame([("com.app11",), (" COM.APP5 ",), ("com.none",)], "package_name string")
    return R.match_apps(count_windows(telemetry(spark, sf_dir)), bad).select("device_id", "window_id", "package_name")


@query("j3_domain_suffix_join", with_ctes(TEL, """
SELECT event_id, dom AS domain, min(b) AS blocked FROM (SELECT event_id, data->>'$.domain' AS dom FROM tel WHERE event_type = 'WEB_DOMAIN') t
JOIN (VALUES ('phishing.test'), ('free-prize-winner.buzz'), ('example.org'), ('c.d.e.example.org')) AS v(b) ON dom = b OR dom LIKE '%.' || b GROUP BY ALL"""))
def j3(spark, sf_dir):
    blocked = spark.createDataFrame([(d,) for d in [*BAD_DOMAINS, "example.org", "c.d.e.example.org"]], "domain string")
    web = telemetry(spark, sf_dir).filter("event_type = 'WEB_DOMAIN'").select("event_id", "package_name", "data")
    return R.match_domains(web, blocked).select("event_id", "domain", "blocked")


@query("j4_dns_contains", with_ctes(TEL, """
SELECT event_id, data->>'$.domain' AS domain, 'free-prize-winner.buzz' AS blocked_by FROM tel WHERE contains(data->>'$.domain', 'free-prize-winner.buzz')"""))
def j4(spark, sf_dir):
    web = parse_payload(telemetry(spark, sf_dir).filter("event_type = 'WEB_DOMAIN'")).select("event_id", F.col("p.domain").alias("domain"))
    return R.match_dns(web, DNS_BLOCKLIST)


_CANARY = """,
canary AS (SELECT device_id, event_id, ts_ms, 10 AS severity, 'MALWARE_MIMICRY' AS threat_type, 'CRITICAL: Unauthorized ' || (data->>'$.action')
  || ' of decoy document ''' || (data->>'$.fileName') || ''' detected. Possible Ransomware/Spyware.' AS message, 0.99::DOUBLE AS confidence,
  'canary:' || (data->>'$.fileName') AS indicator, NULL::VARCHAR AS target_package FROM tel WHERE event_type = 'CANARY_FILE_ACCESS')"""
_PERMS = """,
perms AS (SELECT device_id, event_id, ts_ms, CASE WHEN perm IN ('CAMERA','RECORD_AUDIO') THEN 8 ELSE 7 END AS severity,
  CASE WHEN perm IN ('CAMERA','RECORD_AUDIO') THEN 'INSIDER_THREAT' ELSE 'DEVICE_MISUSE' END AS threat_type,
  CASE WHEN perm IN ('CAMERA','RECORD_AUDIO') THEN '⚠ Side-loaded app ''' || pkg || ''' accessed ' || replace(lower(perm), '_', ' ') || ' — potential surveillance risk'
       ELSE 'Side-loaded app ''' || pkg || ''' accessed location data' END AS message, 0.9::DOUBLE AS confidence,
  'perm:' || pkg || ':' || perm AS indicator, pkg AS target_package
  FROM (SELECT *, data->>'$.permission' AS perm, data->>'$.packageName' AS pkg FROM tel WHERE event_type = 'PERMISSION_ACCESS' AND data->>'$.isSideLoaded' = 'true'))"""
_COLS = "device_id, event_id, ts_ms, severity::INTEGER AS severity, threat_type, message, confidence, indicator, target_package"


@query("d17_canary_alerts", with_ctes(TEL + _CANARY, f"SELECT {_COLS} FROM canary"))
def d17(spark, sf_dir):
    return R.canary_alerts(telemetry(spark, sf_dir)).drop("source")


@query("d18_permission_alerts", with_ctes(TEL + _PERMS, f"SELECT {_COLS} FROM perms"))
def d18(spark, sf_dir):
    return R.permission_alerts(telemetry(spark, sf_dir)).drop("source")


def _sql_list(values):
    return ", ".join("('" + str(v).replace("'", "''") + "')" for v in values)


_TYPOS = ", ".join(f"({i}, '{b}', {j}, '{t}')" for i, (b, ts) in enumerate(BRANDS.items()) for j, t in enumerate(ts))
_OFFICIAL = ", ".join(f"({i}, '{o}')" for i, b in enumerate(BRANDS) for o in OFFICIAL_DOMAINS[b])
_BRAND = ", ".join(f"({i}, '{b}')" for i, b in enumerate(BRANDS))


def phishing_ctes(source: str, exempt: bool = True) -> str:
    """Scores of (domain, url, model) rows of ``source``, one row per distinct combination."""
    guard = "AND NOT official" if exempt else ""
    return f""",
brands(bi, brand) AS (VALUES {_BRAND}),
typos(bi, brand, ti, typo) AS (VALUES {_TYPOS}),
officials(bi, official) AS (VALUES {_OFFICIAL}),
dom AS (SELECT DISTINCT domain, url, model FROM {source}),
base AS (SELECT DISTINCT domain, replace(replace(CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '\\.[^.]*$', '') ELSE domain END, '-', ''), '.', '') AS clean FROM dom),
off AS (SELECT domain, bi, bool_or(domain = official OR ends_with(domain, '.' || official)) AS official FROM base, officials GROUP BY ALL),
thit AS (SELECT domain, bi, arg_min(typo, ti) AS typo FROM base, typos WHERE contains(clean, typo) GROUP BY ALL),
bhit AS (
  SELECT base.domain, brands.brand, thit.typo, contains(clean, brands.brand) AND NOT official AS named,
    row_number() OVER (PARTITION BY base.domain ORDER BY brands.bi) AS rk,
    least((CASE WHEN thit.typo IS NOT NULL {guard} THEN 0.5 ELSE 0 END) + (CASE WHEN contains(clean, brands.brand) AND NOT official THEN 0.35 ELSE 0 END), 0.6) AS brand_score
  FROM base CROSS JOIN brands JOIN off ON off.domain = base.domain AND off.bi = brands.bi
  LEFT JOIN thit ON thit.domain = base.domain AND thit.bi = brands.bi
  WHERE (thit.typo IS NOT NULL {guard}) OR (contains(clean, brands.brand) AND NOT official)),
pat AS (SELECT domain, least(0.45 * ({' + '.join(f"regexp_matches(domain, '(?i){p}')::INT" for p in PHISHING_PATTERNS)}), 0.6) AS pattern_score FROM base),
tld AS (SELECT domain, CASE WHEN list_contains([{', '.join(f"'{t}'" for t in SUSPICIOUS_TLDS)}], regexp_extract(domain, '\\.[^.]*$')) THEN 0.2 ELSE 0 END AS tld_score FROM base),
kw AS (SELECT domain, least(0.15 * count(DISTINCT part) FILTER (part IN (SELECT * FROM (VALUES {_sql_list(SUSPICIOUS_KEYWORDS)}))), 0.4) AS keyword_score
  FROM (SELECT domain, unnest(regexp_split_to_array(domain, '[-.]')) AS part FROM base) GROUP BY domain),
st AS (SELECT domain, least((CASE WHEN len(string_split(domain, '.')) > 4 THEN 0.2 ELSE 0 END) + (CASE WHEN length(domain) > 50 THEN 0.15 ELSE 0 END)
  + (CASE WHEN length(domain) - length(replace(domain, '-', '')) >= 3 THEN 0.15 ELSE 0 END)
  + (CASE WHEN regexp_matches(domain, '[a-z]+\\d{{3,}}') OR regexp_matches(domain, '\\d{{3,}}[a-z]+') THEN 0.1 ELSE 0 END), 0.35) AS structure_score FROM base),
ur AS (SELECT DISTINCT url, least((CASE WHEN length(url) - length(replace(url, '%', '')) > 5 THEN 0.1 ELSE 0 END)
  + (CASE WHEN contains(lower(url), 'javascript:') OR contains(lower(url), 'data:') THEN 0.4 ELSE 0 END)
  + (CASE WHEN contains(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '@') THEN 0.3 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '{'|'.join(URL_PATH_KEYWORDS)}') THEN 0.1 ELSE 0 END), 0.3) AS url_score
  FROM dom WHERE url IS NOT NULL),
risk AS (
  SELECT dom.domain, dom.url, dom.model, pattern_score, tld_score, keyword_score, coalesce(brand_score, 0) AS brand_score, structure_score,
    coalesce(url_score, 0) AS url_score, coalesce(0.35 * dom.model, 0) AS model_score, bhit.brand AS matched_brand, bhit.typo, bhit.named,
    least(1, pattern_score + tld_score + keyword_score + coalesce(brand_score, 0) + structure_score + coalesce(url_score, 0) + coalesce(0.35 * dom.model, 0)) AS total
  FROM dom JOIN pat USING (domain) JOIN tld USING (domain) JOIN kw USING (domain) JOIN st USING (domain)
  LEFT JOIN bhit ON bhit.domain = dom.domain AND rk = 1 LEFT JOIN ur ON ur.url = dom.url)"""


# Pages as visited links: a third of the hosts are replaced by look-alikes built from the page id.
_LINKS = """
links AS (
  SELECT page_id, (page_id % 10) / 10.0::DOUBLE AS model,
    CASE page_id % 6 WHEN 0 THEN url || '/login?x=%20%20%20%20%20%20' WHEN 1 THEN replace(url, '://', '://me@') ELSE url END AS url,
    CASE page_id % 8 WHEN 0 THEN 'secure-login-' || (['paypal','amazon','go0gle','chase'])[(page_id // 8) % 4 + 1] || '-' || page_id || '.xyz'
      WHEN 1 THEN (['mail.','','www1.a.b.c.'])[(page_id // 8) % 3 + 1] || (['google.com','whatsapp.com','apple.com'])[(page_id // 24) % 3 + 1]
      WHEN 2 THEN 'account' || page_id || 'x-update-verify-free.' || (['tk','club','com'])[(page_id // 8) % 3 + 1]
      WHEN 3 THEN 'a-very-long-name-that-goes-on-and-on-for-page-' || page_id || '.example.net'
      WHEN 4 THEN 'amazon.' || (['login','news'])[(page_id // 8) % 2 + 1] || '.example.org'
      WHEN 5 THEN '10.0.' || (page_id % 250) || '.7'
      ELSE regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) END AS domain
  FROM pages)"""
LINKS = _LINKS + phishing_ctes("links")


def links(spark, sf_dir):
    i = F.col("page_id")
    pick = lambda idx, vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (idx + 1).cast("int"))
    text = lambda c: c.cast("string")
    eighth, day = F.floor(i / 8), F.floor(i / 24)
    domain = (
        F.when(i % 8 == 0, F.concat(F.lit("secure-login-"), pick(eighth % 4, ["paypal", "amazon", "go0gle", "chase"]), F.lit("-"), text(i), F.lit(".xyz")))
        .when(i % 8 == 1, F.concat(pick(eighth % 3, ["mail.", "", "www1.a.b.c."]), pick(day % 3, ["google.com", "whatsapp.com", "apple.com"])))
        .when(i % 8 == 2, F.concat(F.lit("account"), text(i), F.lit("x-update-verify-free."), pick(eighth % 3, ["tk", "club", "com"])))
        .when(i % 8 == 3, F.concat(F.lit("a-very-long-name-that-goes-on-and-on-for-page-"), text(i), F.lit(".example.net")))
        .when(i % 8 == 4, F.concat(F.lit("amazon."), pick(eighth % 2, ["login", "news"]), F.lit(".example.org")))
        .when(i % 8 == 5, F.concat(F.lit("10.0."), text(i % 250), F.lit(".7")))
        .otherwise(normalise_domain_raw(F.col("url")))
    )
    url = (
        F.when(i % 6 == 0, F.concat("url", F.lit("/login?x=%20%20%20%20%20%20")))
        .when(i % 6 == 1, F.replace(F.col("url"), F.lit("://"), F.lit("://me@"))).otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), url.alias("url"), (i % 10 / 10.0).alias("model"))


def normalise_domain_raw(url):
    return F.regexp_extract(F.lower(url), "^[a-z]+://([^/?#]*)", 1)


def scored(spark, sf_dir, exempt=True):
    return H.analyse(links(spark, sf_dir), "domain", "url", "model", exempt)


for _id, _column in (("h1_patterns", "pattern_score"), ("h2_suspicious_tld", "tld_score"), ("h3_keywords", "keyword_score"),
                     ("h5_structure", "structure_score"), ("h6_url", "url_score"), ("h7_model_score", "model_score")):
    @query(_id, f"WITH {LINKS} SELECT page_id, domain, round({_column}, 6)::DOUBLE AS {_column} FROM links JOIN risk USING (domain, url, model)")
    def _score(spark, sf_dir, _column=_column):
        return scored(spark, sf_dir).select("page_id", "domain", F.round(_column, 6).alias(_column))


@query("h4_typosquatting", f"WITH {LINKS} SELECT page_id, domain, round(brand_score, 6)::DOUBLE AS brand_score, matched_brand FROM links JOIN risk USING (domain, url, model)")
def h4(spark, sf_dir):
    return scored(spark, sf_dir).select("page_id", "domain", F.round("brand_score", 6).alias("brand_score"), "matched_brand")


@query("h4_typosquatting_no_exemption", f"WITH {_LINKS + phishing_ctes('links', False)} SELECT page_id, domain, round(brand_score, 6)::DOUBLE AS brand_score, matched_brand FROM links JOIN risk USING (domain, url, model)")
def h4_raw(spark, sf_dir):
    return scored(spark, sf_dir, False).select("page_id", "domain", F.round("brand_score", 6).alias("brand_score"), "matched_brand")


@query("j5_brand_join", f"WITH {LINKS} SELECT page_id, matched_brand, typo, coalesce(named, false) AS named FROM links JOIN risk USING (domain, url, model) WHERE matched_brand IS NOT NULL")
def j5(spark, sf_dir):
    hit = H.brand_match(F.lower(F.trim("domain")))
    return links(spark, sf_dir).withColumn("b", hit).filter("b IS NOT NULL").select(
        "page_id", F.col("b.brand").alias("matched_brand"), "b.typo", "b.named"
    )


@query("h8_risk_class", f"""WITH {LINKS} SELECT page_id, domain, round(total, 3)::DOUBLE AS risk_score,
CASE WHEN total >= 0.7 THEN 'phishing' WHEN total >= 0.4 THEN 'suspicious' ELSE 'safe' END AS classification, matched_brand,
(CASE WHEN regexp_matches(domain, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') THEN 1 ELSE 0 END)::INTEGER AS ip_reason FROM links JOIN risk USING (domain, url, model)""")
def h8(spark, sf_dir):
    out = scored(spark, sf_dir)
    ip = F.exists("reasons", lambda r: r.contains("\\d{1,3}"))
    return out.select("page_id", "domain", "risk_score", "classification", "matched_brand", ip.cast("int").alias("ip_reason"))


_WEB = TEL + """,
web AS (SELECT device_id, event_id, ts_ms, package_name, data->>'$.domain' AS domain, NULL::VARCHAR AS url, NULL::DOUBLE AS model FROM tel WHERE event_type = 'WEB_DOMAIN')"""
_PHISH = _WEB + phishing_ctes("web") + """,
phish AS (SELECT device_id, event_id, ts_ms, CASE WHEN total >= 0.7 THEN 9 ELSE 6 END AS severity, 'PHISHING' AS threat_type,
  (CASE WHEN total >= 0.7 THEN '⚠ Phishing' ELSE 'Suspicious' END) || ' website detected: ' || domain
  || coalesce(' (impersonating ' || matched_brand || ')', '') || ' — risk score ' || CAST(round_even(round(total, 3) * 100, 0) AS INT) || '%' AS message,
  round(total, 3)::DOUBLE AS confidence, 'phishing:' || domain AS indicator, package_name AS target_package
  FROM web JOIN risk USING (domain) WHERE total >= 0.4)"""


@query("d19_phishing_alerts", with_ctes(_PHISH, f"SELECT {_COLS} FROM phish"))
def d19(spark, sf_dir):
    return H.phishing_alerts(telemetry(spark, sf_dir)).drop("source")


def _greedy(source: str, key: str, gap: int) -> str:
    """Kept rows of a greedy cooldown: the next row is the first at least ``gap`` after the last."""
    return f""",
o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts_ms, event_id) AS rn FROM {source}),
g AS (SELECT * EXCLUDE (rn), rn, ts_ms AS last_ms, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.* EXCLUDE (rn), o.rn, CASE WHEN o.ts_ms - g.last_ms >= {gap} THEN o.ts_ms ELSE g.last_ms END, o.ts_ms - g.last_ms >= {gap}
  FROM g JOIN o ON o.rn = g.rn + 1 AND ({' AND '.join(f'o.{k.strip()} = g.{k.strip()}' for k in key.split(','))}))"""


_ALL = _PHISH + _CANARY + _PERMS + """,
every AS (SELECT device_id, event_id, ts_ms, lower(indicator) AS indicator FROM phish UNION ALL SELECT device_id, event_id, ts_ms, lower(indicator) FROM canary
  UNION ALL SELECT device_id, event_id, ts_ms, lower(indicator) FROM perms)"""


def fast_path_alerts(spark, sf_dir):
    tel = telemetry(spark, sf_dir)
    return H.phishing_alerts(tel).unionByName(R.canary_alerts(tel)).unionByName(R.permission_alerts(tel))


# Events of one device and indicator are days apart, so the cooldown is set to two days here.
@query("d20_indicator_cooldown", with_recursive(_ALL + _greedy("every", "device_id, indicator", 172_800_000), "SELECT device_id, event_id, indicator FROM g WHERE kept"))
def d20(spark, sf_dir):
    made = fast_path_alerts(spark, sf_dir).select("device_id", "event_id", "ts_ms", F.lower("indicator").alias("indicator"))
    made = materialise(made, "fast-path")  # the cooldown reads its input twice, the telemetry is read once
    return R.greedy_cooldown(made, ["device_id", "indicator"], 172_800_000).select("device_id", "event_id", "indicator")


# Each device debounces for itself: a domain, an app's permission, a decoy file. Test events are days apart, so the spans are longer.
def _debounced(source: str, item: str, gap: int) -> str:
    return with_recursive(TEL + f""",
fw AS (SELECT device_id, event_id, ts_ms, {item} FROM tel WHERE event_type = '{source}')""" + _greedy("fw", "device_id, item", gap), "SELECT device_id, item, event_id FROM g WHERE kept")


def _debounce(spark, sf_dir, source, item, gap):
    seen = parse_payload(telemetry(spark, sf_dir).filter(F.col("event_type") == source)).select("device_id", item.alias("item"), "event_id", "ts_ms")
    return R.greedy_cooldown(seen, ["device_id", "item"], gap).select("device_id", "item", "event_id")


@query("r3_debounce", _debounced("WEB_DOMAIN", "data->>'$.domain' AS item", 172_800_000))
def r3_domain(spark, sf_dir):
    return _debounce(spark, sf_dir, "WEB_DOMAIN", normalise_domain(F.col("p.domain")), 172_800_000)


@query("r3_debounce_permission", _debounced("PERMISSION_ACCESS", "package_name || '/' || (data->>'$.permission') AS item", 345_600_000))
def r3_permission(spark, sf_dir):
    return _debounce(spark, sf_dir, "PERMISSION_ACCESS", F.concat_ws("/", "package_name", "p.permission"), 345_600_000)


@query("r3_debounce_file", _debounced("CANARY_FILE_ACCESS", "package_name || '/' || (data->>'$.fileName') AS item", 691_200_000))
def r3_file(spark, sf_dir):
    return _debounce(spark, sf_dir, "CANARY_FILE_ACCESS", F.concat_ws("/", "package_name", "p.fileName"), 691_200_000)
