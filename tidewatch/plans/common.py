"""Shared pieces of the comparison SQL: the telemetry mapping and the windows as CTEs."""

from __future__ import annotations

from tidewatch.sources.telemetry import DOMAINS

_DOMAIN_LIST = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"

TEL = f"""
raw AS (
  SELECT event_id, user_id, event_type AS e, epoch_us(ts) // 1000 AS ts_ms, value,
         CAST(floor(value) AS BIGINT) AS v, CAST(props::JSON->>'$.k' AS BIGINT) AS k
  FROM events),
tel AS (
  SELECT 'dev_' || user_id AS device_id, event_id, ts_ms,
    CASE WHEN e='view' THEN 'APP_USAGE'
         WHEN e='click' AND k<34 THEN 'KEYSTROKE' WHEN e='click' AND k<67 THEN 'TOUCH' WHEN e='click' THEN 'SWIPE'
         WHEN e='purchase' AND k<60 THEN 'NETWORK_APP' WHEN e='purchase' AND k<80 THEN 'NETWORK_TRAFFIC'
         WHEN e='purchase' THEN 'NETWORK_FLOW'
         WHEN e='error' AND k<50 THEN 'SECURITY_AUTH_EVENT' WHEN e='error' AND k<80 THEN 'SECURITY_PACKAGE_EVENT'
         WHEN e='error' THEN 'CANARY_FILE_ACCESS'
         WHEN e='signup' AND k<40 THEN 'SYSTEM_STATE' WHEN e='signup' AND k<60 THEN 'PERMISSION_ACCESS'
         WHEN e='signup' AND k<90 THEN 'WEB_DOMAIN' WHEN e='signup' THEN 'SYSTEM_LOGCAT_ACCESS' END AS event_type,
    CASE WHEN e IN ('view','click') OR (e='purchase' AND k<60) OR (e='error' AND k BETWEEN 50 AND 79)
              OR (e='signup' AND k BETWEEN 40 AND 59) THEN 'com.app' || (k % 12)
         WHEN e='error' AND k>=80 THEN 'system_level'
         WHEN e='signup' AND k BETWEEN 60 AND 89 THEN 'com.android.chrome' END AS package_name,
    CASE WHEN e='view' THEN '{{"totalTime":' || v || ',"count":1}}'
         WHEN e='click' AND k<34 THEN '{{"latency":' || v || '}}'
         WHEN e='click' AND k<67 THEN '{{"duration":' || v || '}}'
         WHEN e='click' THEN '{{"velocity":' || v || '}}'
         WHEN e='purchase' AND k<60 THEN '{{"uid":' || (10000 + k % 12) || ',"rxBytesDelta":' || (v*65536)
              || ',"txBytesDelta":' || (k*16384) || '}}'
         WHEN e='purchase' AND k<80 THEN '{{"rxBytesDelta":' || (v*65536) || ',"txBytesDelta":' || (k*16384) || '}}'
         WHEN e='purchase' THEN '{{"protocol":"' || (['TCP','UDP'])[k%2+1] || '","dstIp":"10.0.0.' || (k%8)
              || '","dstPort":' || ([53,80,443,8080])[k%4+1] || ',"bytes":' || (v*131072) || '}}'
         WHEN e='error' AND k<50 THEN
              '{{"event":"' || (['USER_PRESENT','SCREEN_ON','SCREEN_OFF','AUTH_FAIL'])[k%4+1] || '"}}'
         WHEN e='error' AND k<80 THEN
              '{{"action":"' || (['PACKAGE_ADDED','PACKAGE_REMOVED','PACKAGE_REPLACED'])[k%3+1] || '"}}'
         WHEN e='error' THEN '{{"fileName":"f' || k || '.pdf","action":"' || (['MODIFY','DELETE','OPEN'])[k%3+1] || '"}}'
         WHEN e='signup' AND k<40 THEN '{{"lowMemory":' || (k<5) || ',"batteryPct":' || k || ',"tz_offset":'
              || ((k%3)*3600000) || '}}'
         WHEN e='signup' AND k<60 THEN '{{"permission":"'
              || (['CAMERA','RECORD_AUDIO','FINE_LOCATION','COARSE_LOCATION'])[k%4+1]
              || '","isSideLoaded":' || (k<50) || ',"packageName":"com.app' || (k%12) || '"}}'
         WHEN e='signup' AND k<90 THEN '{{"domain":"' || ({_DOMAIN_LIST})[k%10+1] || '"}}'
         WHEN e='signup' THEN '{{"status":"' || (['restricted','available'])[k%2+1] || '"}}' END AS data
  FROM raw)"""

# Windows of five events per device, in (time, event id) order, complete ones only.
WIN = TEL + """,
num AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) - 1 AS rn,
         count(*) OVER (PARTITION BY device_id) AS cnt
  FROM tel),
win AS (
  SELECT device_id, event_id, ts_ms, event_type, package_name, data, rn // 5 AS window_id, rn % 5 AS pos
  FROM num WHERE rn // 5 < cnt // 5)"""


def with_ctes(ctes: str, select: str) -> str:
    """``select`` may start with further CTEs after a leading comma."""
    return f"WITH {ctes.strip()}\n{select.strip()}"


def with_recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"


# Alerts and log lines derived from the tables, as in tidewatch.sources.telemetry.
ALR = TEL + """,
alr AS (
  SELECT 'alt_' || event_id AS anomaly_id, device_id, event_id AS alert_seq,
    CASE event_type WHEN 'CANARY_FILE_ACCESS' THEN 10
      WHEN 'PERMISSION_ACCESS' THEN CASE WHEN data->>'$.isSideLoaded' = 'true' THEN 8 ELSE 5 END
      WHEN 'SECURITY_PACKAGE_EVENT' THEN 7 WHEN 'SECURITY_AUTH_EVENT' THEN 4
      WHEN 'WEB_DOMAIN' THEN CASE WHEN data->>'$.domain' IN ('login.phishing.test','free-prize-winner.buzz') THEN 9 ELSE 6 END
      ELSE 3 END AS severity,
    CASE WHEN event_type = 'CANARY_FILE_ACCESS' THEN 'MALWARE_MIMICRY'
      WHEN event_type IN ('PERMISSION_ACCESS','SECURITY_PACKAGE_EVENT') THEN 'INSIDER_THREAT'
      WHEN event_type = 'SECURITY_AUTH_EVENT' THEN 'DEVICE_MISUSE'
      WHEN event_type = 'WEB_DOMAIN' THEN CASE WHEN event_id % 2 = 0 THEN 'PHISHING' ELSE 'MALWARE_MIMICRY' END
      ELSE 'USER_DRIFT' END AS threat_type,
    CASE WHEN event_type = 'PERMISSION_ACCESS' AND event_id % 2 = 0 THEN 'perm:' || package_name
      WHEN event_type = 'SECURITY_PACKAGE_EVENT' AND event_id % 2 = 0 THEN 'app:' || package_name
      WHEN event_type = 'WEB_DOMAIN' AND event_id % 3 = 0 THEN 'domain:' || (data->>'$.domain')
      WHEN event_type = 'WEB_DOMAIN' AND event_id % 3 = 1 THEN 'phishing:' || (data->>'$.domain') END AS indicator,
    CASE event_type WHEN 'WEB_DOMAIN' THEN 'Known malicious website detected: ' || (data->>'$.domain')
      WHEN 'SECURITY_PACKAGE_EVENT' THEN 'Known malicious app activity detected: ' || package_name
      WHEN 'PERMISSION_ACCESS' THEN lower('Permission use: ' || (data->>'$.permission'))
      ELSE event_type END AS message,
    (event_id % 50 + 50) / 100.0::DOUBLE AS confidence,
    (['pending','approved','denied','normal'])[event_id % 4 + 1] AS status,
    ts_ms AS created_ms
  FROM tel
  WHERE event_type IN ('CANARY_FILE_ACCESS','PERMISSION_ACCESS','SECURITY_PACKAGE_EVENT','SECURITY_AUTH_EVENT',
                       'WEB_DOMAIN','NETWORK_FLOW'))"""

LOG = """
log AS (
  SELECT doc_id AS line_no,
    CASE WHEN doc_id % 50 = 25 THEN '--------- beginning of ' || (['main','system','crash'])[(doc_id // 50) % 3 + 1]
      WHEN doc_id % 17 = 5 THEN 'raw ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g')
      ELSE lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' '
        || lpad((doc_id % 24)::VARCHAR, 2, '0') || ':' || lpad((doc_id % 60)::VARCHAR, 2, '0') || ':'
        || lpad(((doc_id // 60) % 60)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' '
        || (doc_id % 5000 + 1) || ' ' || (doc_id % 300 + 1) || ' ' || (['V','D','I','W','E','F','A'])[doc_id % 7 + 1] || ' '
        || CASE WHEN doc_id % 11 = 0 THEN 'auditd' WHEN doc_id % 13 = 0 THEN 'thermal' ELSE source END
        || ': ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g') END AS line
  FROM documents)"""

# The 72 dimensions of every window in long form: feat(device_id, window_id, dim, val).
FEAT = WIN + """,
pay AS (
  SELECT *, upper(event_type) AS kind,
    try_cast(coalesce(data->>'$.latency', data->>'$.interval') AS DOUBLE) AS latency,
    try_cast(data->>'$.duration' AS DOUBLE) AS duration,
    try_cast(coalesce(data->>'$.velocity', data->>'$.speed') AS DOUBLE) AS velocity,
    greatest(0, coalesce(try_cast(data->>'$.rxBytesDelta' AS DOUBLE), 0))
      + greatest(0, coalesce(try_cast(data->>'$.txBytesDelta' AS DOUBLE), 0)) AS rxtx,
    try_cast(data->>'$.tz_offset' AS BIGINT) AS tz,
    coalesce(data->>'$.lowMemory' = 'true', false) AS low,
    coalesce(try_cast(data->>'$.batteryPct' AS DOUBLE), -1) AS battery,
    lower(coalesce(data->>'$.status', '')) AS status
  FROM win),
wins AS (SELECT device_id, window_id, count(*) AS n, count(*) FILTER (ts_ms > 0) AS timed FROM pay GROUP BY ALL),
tzs AS (SELECT device_id, window_id, arg_min(tz, pos) AS tz FROM pay WHERE kind = 'SYSTEM_STATE' AND tz IS NOT NULL GROUP BY ALL),
hrs AS (
  SELECT device_id, window_id, ((ts_ms + coalesce(tzs.tz, 0)) // 3600000) % 24 AS h
  FROM pay LEFT JOIN tzs USING (device_id, window_id) WHERE ts_ms > 0),
f_hours AS (
  SELECT device_id, window_id, h AS dim, count(*) / any_value(timed) AS val
  FROM hrs JOIN wins USING (device_id, window_id) GROUP BY device_id, window_id, h),
ap AS (
  SELECT device_id, window_id, package_name AS pkg,
         row_number() OVER (PARTITION BY device_id, window_id ORDER BY pos) AS ap
  FROM pay WHERE kind = 'APP_USAGE' AND package_name <> ''),
ac AS (SELECT device_id, window_id, pkg, count(*) AS c, min(ap) AS fs FROM ap GROUP BY ALL),
top AS (
  SELECT *, row_number() OVER (PARTITION BY device_id, window_id ORDER BY c DESC, fs) - 1 AS idx,
         sum(c) OVER (PARTITION BY device_id, window_id) AS tot FROM ac QUALIFY idx < 10),
f_freq AS (SELECT device_id, window_id, 24 + idx AS dim, c / tot AS val FROM top),
pr AS (
  SELECT a.device_id, a.window_id, a.pkg AS s, b.pkg AS d, a.ap AS i FROM ap a
  JOIN ap b ON a.device_id = b.device_id AND a.window_id = b.window_id AND b.ap = a.ap + 1
  JOIN top ts ON ts.device_id = a.device_id AND ts.window_id = a.window_id AND ts.pkg = a.pkg
  JOIN top td ON td.device_id = a.device_id AND td.window_id = a.window_id AND td.pkg = b.pkg),
pc AS (
  SELECT *, sum(c) OVER (PARTITION BY device_id, window_id, s) AS out_n, sum(c) OVER (PARTITION BY device_id, window_id) AS all_n,
         min(fi) OVER (PARTITION BY device_id, window_id, s) AS s_seen
  FROM (SELECT device_id, window_id, s, d, count(*) AS c, min(i) AS fi FROM pr GROUP BY ALL)),
f_ent AS (
  SELECT pc.device_id, pc.window_id, 34 + any_value(idx) AS dim, -sum(pc.c / out_n * log2(pc.c / out_n)) AS val
  FROM pc JOIN top ON top.device_id = pc.device_id AND top.window_id = pc.window_id AND top.pkg = pc.s
  GROUP BY pc.device_id, pc.window_id, s),
tr AS (
  SELECT pc.device_id, pc.window_id, idx, pc.c / all_n AS share, s, d,
         row_number() OVER (PARTITION BY pc.device_id, pc.window_id ORDER BY pc.c DESC, s_seen, fi) AS rk
  FROM pc JOIN top ON top.device_id = pc.device_id AND top.window_id = pc.window_id AND top.pkg = pc.s),
f_trans AS (
  SELECT device_id, window_id, 44 + 2 * (rk - 1) AS dim, idx / 10 AS val FROM tr WHERE rk <= 4
  UNION ALL SELECT device_id, window_id, 45 + 2 * (rk - 1), share FROM tr WHERE rk <= 4),
meas AS (
  SELECT device_id, window_id, 52 AS base, latency AS x FROM pay WHERE kind = 'KEYSTROKE' AND latency IS NOT NULL
  UNION ALL SELECT device_id, window_id, 57, duration FROM pay WHERE kind = 'TOUCH' AND duration IS NOT NULL
  UNION ALL SELECT device_id, window_id, 62, velocity FROM pay WHERE kind = 'SWIPE' AND velocity IS NOT NULL),
ms AS (
  SELECT device_id, window_id, base, avg(x) AS a, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi,
         least(count(*) / 100, 1) AS c, count(*) AS n FROM meas GROUP BY ALL),
f_stats AS (
  SELECT device_id, window_id, base AS dim, a AS val FROM ms UNION ALL SELECT device_id, window_id, base + 1, s FROM ms
  UNION ALL SELECT device_id, window_id, base + 2, lo FROM ms UNION ALL SELECT device_id, window_id, base + 3, hi FROM ms
  UNION ALL SELECT device_id, window_id, base + 4, c FROM ms),
gaps AS (
  SELECT device_id, window_id, ts_ms - lag(ts_ms) OVER (PARTITION BY device_id, window_id ORDER BY pos) AS gap
  FROM pay WHERE ts_ms <> 0),
burst AS (
  SELECT device_id, window_id, CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 0 END AS burst
  FROM gaps GROUP BY ALL),
comb AS (
  SELECT device_id, window_id, count(*) AS n,
    count(*) FILTER ((kind = 'KEYSTROKE' AND latency IS NOT NULL) OR (kind = 'TOUCH' AND duration IS NOT NULL)
                     OR (kind = 'SWIPE' AND velocity IS NOT NULL)) AS acts,
    count(*) FILTER (kind IN ('NETWORK_TRAFFIC','NETWORK_APP')) AS nets,
    coalesce(sum(rxtx) FILTER (kind IN ('NETWORK_TRAFFIC','NETWORK_APP')), 0) / 1048576 AS mb,
    count(*) FILTER (kind LIKE 'SECURITY\\_%' ESCAPE '\\') AS sec,
    count(*) FILTER (kind LIKE 'SYSTEM\\_%' ESCAPE '\\') AS sys,
    count(*) FILTER (kind = 'SYSTEM_STATE') AS states,
    count(*) FILTER (kind = 'SYSTEM_STATE' AND low) AS lows,
    count(*) FILTER (kind = 'SYSTEM_STATE' AND battery BETWEEN 0 AND 15) AS weak,
    count(*) FILTER (kind = 'SYSTEM_LOGCAT_ACCESS') AS logcat,
    count(*) FILTER (kind = 'SYSTEM_LOGCAT_ACCESS' AND status IN ('restricted','error')) AS restricted
  FROM pay GROUP BY ALL),
comb5 AS (
  SELECT device_id, window_id, least(n / 500, 1) AS c0, acts / n AS c1, least(1, nets / n + least(mb / 10, 1) * 0.5) AS c2,
    sec / n AS c3,
    greatest(coalesce(burst, 0), sys / n, (lows + weak) / greatest(states * 2, 1), restricted / greatest(states + logcat, 1)) AS c4,
    coalesce(burst, 0) AS burst
  FROM comb LEFT JOIN burst USING (device_id, window_id)),
f_comb AS (
  SELECT device_id, window_id, 67 AS dim, c0 AS val FROM comb5 UNION ALL SELECT device_id, window_id, 68, c1 FROM comb5
  UNION ALL SELECT device_id, window_id, 69, c2 FROM comb5 UNION ALL SELECT device_id, window_id, 70, c3 FROM comb5
  UNION ALL SELECT device_id, window_id, 71, c4 FROM comb5),
filled AS (
  SELECT * FROM f_hours UNION ALL SELECT * FROM f_freq UNION ALL SELECT * FROM f_ent UNION ALL SELECT * FROM f_trans
  UNION ALL SELECT * FROM f_stats UNION ALL SELECT * FROM f_comb),
feat AS (
  SELECT device_id, window_id, dim, coalesce(val, 0)::DOUBLE AS val
  FROM (SELECT device_id, window_id, unnest(range(72)) AS dim FROM wins) LEFT JOIN filled USING (device_id, window_id, dim)),
msk AS (
  SELECT device_id, window_id, dim,
    CASE WHEN dim < 24 THEN timed > 0
         WHEN dim < 52 THEN EXISTS (SELECT 1 FROM ap WHERE ap.device_id = w.device_id AND ap.window_id = w.window_id)
         WHEN dim < 67 THEN EXISTS (SELECT 1 FROM ms WHERE ms.device_id = w.device_id AND ms.window_id = w.window_id
                                    AND ms.base = 52 + ((dim - 52) // 5) * 5)
         ELSE true END::INTEGER AS m
  FROM (SELECT *, unnest(range(72)) AS dim FROM wins) w)"""


def feature_slice(low: int, high: int) -> str:
    """Dimensions low..high-1 per window as comma separated millionths."""
    return (
        "SELECT device_id, window_id, string_agg(CAST(round(val * 1000000) AS BIGINT)::VARCHAR, ',' ORDER BY dim) AS vec "
        f"FROM feat WHERE dim >= {low} AND dim < {high} GROUP BY ALL"
    )


def millionths(column: str):
    """The Spark side of ``feature_slice``: an array of doubles as text of whole millionths."""
    from pyspark.sql import functions as F

    return F.array_join(F.expr(f"transform({column}, x -> CAST(round(x * 1000000) AS BIGINT))"), ",")
