"""Phishing risk of a domain, with an optional URL and device-model score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import fixed
from tidewatch.functions.payload import num, parse_payload
from tidewatch.settings import (
    BRANDS, OFFICIAL_DOMAINS, PHISHING_AT, PHISHING_PATTERNS, SUSPICIOUS_AT, SUSPICIOUS_KEYWORDS, SUSPICIOUS_TLDS,
    URL_PATH_KEYWORDS,
)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pattern_score(domain: Column) -> tuple[Column, list[Column]]:
    hits = [F.coalesce(domain.rlike(f"(?i){p}"), F.lit(False)) for p in PHISHING_PATTERNS]
    total = sum((h.cast("int") for h in hits), F.lit(0))
    reasons = [
        F.when(h, F.lit(f"Matches known phishing pattern: {p[:60]}")) for h, p in zip(hits, PHISHING_PATTERNS)
    ]
    return F.least(total * 0.45, F.lit(0.6)), reasons


def tld_score(domain: Column) -> tuple[Column, list[Column]]:
    tld = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    hit = domain.contains(".") & tld.isin(*SUSPICIOUS_TLDS)
    return F.when(hit, 0.2).otherwise(0.0), [F.when(hit, F.concat(F.lit("Uses suspicious TLD: "), tld))]


def keyword_score(domain: Column) -> tuple[Column, list[Column]]:
    found = F.array_intersect(F.split(domain, r"[-.]"), _texts(SUSPICIOUS_KEYWORDS))
    reason = F.concat(
        F.lit("Suspicious keywords in domain: "), F.array_join(F.slice(F.array_sort(found), 1, 3), ", ")
    )
    return F.least(F.size(found) * 0.15, F.lit(0.4)), [F.when(F.size(found) > 0, reason)]


def brand_match(domain: Column, exempt_official: bool = True) -> Column:
    """First brand imitated by the domain: struct(brand, typo, named), or null.

    With ``exempt_official`` a brand's own domains and their subdomains never count.
    """
    base = F.when(domain.contains("."), F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)).otherwise(domain)
    clean = F.translate(base, "-.", "")
    # A constant array (14 entries), folded once by the optimizer and scanned in order.
    known = F.array(*[
        F.struct(F.lit(b).alias("brand"), _texts(t).alias("typos"), _texts(OFFICIAL_DOMAINS[b]).alias("official"))
        for b, t in BRANDS.items()
    ])

    def against(b: Column) -> Column:
        official = F.exists(b["official"], lambda o: (domain == o) | F.endswith(domain, F.concat(F.lit("."), o)))
        typo = F.get(F.filter(b["typos"], lambda t: F.contains(clean, t)), F.lit(0))
        if exempt_official:
            typo = F.when(~official, typo)
        return F.struct(
            b["brand"].alias("brand"), typo.alias("typo"), (F.contains(clean, b["brand"]) & ~official).alias("named")
        )

    hit = F.get(F.filter(F.transform(known, against), lambda h: h["typo"].isNotNull() | h["named"]), F.lit(0))
    return hit


def brand_score(hit: Column) -> Column:
    score = F.when(hit["typo"].isNotNull(), 0.5).otherwise(0.0) + F.when(hit["named"], 0.35).otherwise(0.0)
    return F.least(score, F.lit(0.6))


def structure_score(domain: Column) -> tuple[Column, list[Column]]:
    levels = F.size(F.split(domain, r"\."))
    hyphens = F.length(domain) - F.length(F.translate(domain, "-", ""))
    digits = domain.rlike(r"[a-z]+\d{3,}") | domain.rlike(r"\d{3,}[a-z]+")
    size = F.length(domain)
    score = (
        F.when(levels > 4, 0.2).otherwise(0.0) + F.when(size > 50, 0.15).otherwise(0.0)
        + F.when(hyphens >= 3, 0.15).otherwise(0.0) + F.when(digits, 0.1).otherwise(0.0)
    )
    text = lambda c: c.cast("string")
    return F.least(score, F.lit(0.35)), [
        F.when(levels > 4, F.concat(F.lit("Excessive subdomain depth ("), text(levels), F.lit(" levels)"))),
        F.when(size > 50, F.concat(F.lit("Unusually long domain ("), text(size), F.lit(" chars)"))),
        F.when(hyphens >= 3, F.concat(F.lit("Many hyphens in domain ("), text(hyphens), F.lit(")"))),
        F.when(digits, F.lit("Contains suspicious numeric sequences")),
    ]


def url_score(url: Column) -> tuple[Column, list[Column]]:
    low = F.lower(url)
    encoded = (F.length(url) - F.length(F.translate(url, "%", ""))) > 5
    scheme = low.contains("javascript:") | low.contains("data:")
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    at_sign = authority.contains("@")
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    words = F.filter(_texts(URL_PATH_KEYWORDS), lambda w: path.contains(w))
    score = (
        F.when(encoded, 0.1).otherwise(0.0) + F.when(scheme, 0.4).otherwise(0.0)
        + F.when(at_sign, 0.3).otherwise(0.0) + F.when(F.size(words) > 0, 0.1).otherwise(0.0)
    )
    return F.coalesce(F.least(score, F.lit(0.3)), F.lit(0.0)), [
        F.when(encoded, F.lit("Excessive URL encoding")),
        F.when(scheme, F.lit("Suspicious protocol in URL")),
        F.when(at_sign, F.lit("URL contains @ symbol (possible obfuscation)")),
        F.when(F.size(words) > 0, F.concat(F.lit("Suspicious path keywords: "), F.array_join(F.slice(words, 1, 3), ", "))),
    ]


def model_score(score: Column) -> tuple[Column, list[Column]]:
    text = F.concat(F.lit("On-device TFLite model classified as high-risk (score: "), fixed(score, 2), F.lit(")"))
    return F.coalesce(score * 0.35, F.lit(0.0)), [F.when(score > 0.6, text)]


def analyse(
    df: DataFrame, domain: str = "domain", url: str | None = None, model: str | None = None,
    exempt_official: bool = True, phishing_at: float = PHISHING_AT, suspicious_at: float = SUSPICIOUS_AT,
) -> DataFrame:
    """Adds the part scores, ``risk_score``, ``classification``, ``reasons`` and ``matched_brand``."""
    name = F.lower(F.trim(F.col(domain)))
    link = F.col(url) if url else F.lit(None).cast("string")
    given = F.col(model) if model else F.lit(None).cast("double")
    out = df.withColumn("_brand", brand_match(name, exempt_official))
    brand = F.col("_brand")
    parts = {
        "pattern_score": pattern_score(name),
        "tld_score": tld_score(name),
        "keyword_score": keyword_score(name),
        "brand_score": (
            brand_score(brand),
            [
                F.when(brand["typo"].isNotNull(), F.concat(F.lit("Possible typosquatting of '"), brand["brand"],
                                                           F.lit("' (found: '"), brand["typo"], F.lit("')"))),
                F.when(brand["named"], F.concat(F.lit("Uses brand name '"), brand["brand"], F.lit("' in non-official domain"))),
            ],
        ),
        "structure_score": structure_score(name),
        "url_score": url_score(link),
        "model_score": model_score(given),
    }
    reasons = [r for _, texts in parts.values() for r in texts]
    total = F.lit(0.0)
    for score, _ in parts.values():
        total = total + score
    capped = F.least(total, F.lit(1.0))
    label = F.when(capped >= phishing_at, "phishing").when(capped >= suspicious_at, "suspicious").otherwise("safe")
    result = F.struct(
        *[score.cast("double").alias(column) for column, (score, _) in parts.items()],
        F.bround(capped, 3).alias("risk_score"),
        label.alias("classification"),
        F.slice(F.array_compact(F.array(*reasons)), 1, 5).alias("reasons"),
        brand["brand"].alias("matched_brand"),
    )
    # Unpacked by a generator, so that a filter on the result is not pushed down as a copy of
    # the whole expression.
    return out.select(*df.columns, F.inline(F.array(result)))


def phishing_alerts(tel: DataFrame, exempt_official: bool = True) -> DataFrame:
    """Alerts for visited domains that are not safe."""
    web = parse_payload(tel.filter(F.upper("event_type") == "WEB_DOMAIN"))
    web = web.select(
        "device_id", "event_id", "ts_ms", "package_name",
        F.lower(F.trim("p.domain")).alias("domain"), F.col("p.url").alias("url"), num(F.col("p.tfliteScore")).alias("model"),
    ).filter(F.coalesce(F.col("domain"), F.lit("")) != "")
    scored = analyse(web, "domain", "url", "model", exempt_official).filter(F.col("classification") != "safe")
    bad = F.col("classification") == "phishing"
    # Rounded to the nearest even percent on ties, as text.
    percent = F.bround(F.col("risk_score") * 100, 0).cast("int").cast("string")
    return scored.select(
        "device_id", "event_id", "ts_ms",
        F.when(bad, 9).otherwise(6).alias("severity"),
        F.lit("PHISHING").alias("threat_type"),
        F.concat(
            F.when(bad, "⚠ Phishing").otherwise("Suspicious"), F.lit(" website detected: "), F.col("domain"),
            F.coalesce(F.concat(F.lit(" (impersonating "), F.col("matched_brand"), F.lit(")")), F.lit("")),
            F.lit(" — risk score "), percent, F.lit("%"),
        ).alias("message"),
        F.col("risk_score").alias("confidence"),
        F.concat(F.lit("phishing:"), F.col("domain")).alias("indicator"),
        F.col("package_name").alias("target_package"),
        F.lit("phishing-analyzer").alias("source"),
    )
