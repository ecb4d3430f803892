"""Row-level filters and derived columns; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.payload import csv_tokens
from tidewatch.settings import LOG_NOISE, STORE_INSTALLERS, SYSTEM_PACKAGE_PREFIXES

_FAIL = "FAIL|DENIED|LOCK|ERROR"


def drop_ignored_devices(df: DataFrame, ids: str = "", prefixes: str = "") -> DataFrame:
    """Drops rows of device ids in a comma list, or starting with one of the prefixes."""
    device = F.lower(F.trim(F.col("device_id")))
    listed = F.array_contains(csv_tokens(F.lit(ids)), device)
    prefixed = F.exists(csv_tokens(F.lit(prefixes)), lambda p: device.startswith(p))
    return df.filter((device != "") & ~listed & ~prefixed)


def drop_ignored_packages(df: DataFrame, packages: DataFrame) -> DataFrame:
    """Left-anti join with a table of package names; compared in lower case."""
    ignored = packages.select(F.lower(F.trim("package_name")).alias("_pkg")).distinct()
    return df.join(ignored, F.lower(F.trim(df["package_name"])) == ignored["_pkg"], "left_anti")


def quiet_lines(df: DataFrame, line: str = "line", package_filter: str = "") -> DataFrame:
    """Removes noisy system lines, and lines without the given text when one is set."""
    low = F.lower(F.col(line))
    noisy = F.lit(False)
    for token in LOG_NOISE:
        noisy = noisy | low.contains(token)
    keep = ~noisy & (F.length(line) > 0)
    wanted = package_filter.lower().strip()
    if wanted:
        keep = keep & low.contains(wanted)
    return df.filter(keep)


def is_system_package(package: Column) -> Column:
    low = F.lower(package)
    out = F.lit(False)
    for prefix in SYSTEM_PACKAGE_PREFIXES:
        out = out | low.startswith(prefix)
    return out


def is_side_loaded(installer: Column) -> Column:
    return F.when(installer.isNull() | (F.trim(installer) == ""), True).otherwise(~installer.isin(*STORE_INSTALLERS))


def event_severity(event_type: Column, explicit: Column | None = None) -> Column:
    kind = F.upper(event_type)
    by_type = (
        F.when(kind.startswith("SECURITY_"), 7)
        .when(kind.startswith("NETWORK_FLOW"), 6)
        .when(kind.startswith("NETWORK"), 5)
        .when(kind.startswith("SYSTEM"), 4)
        .otherwise(2)
    )
    if explicit is None:
        return by_type
    return F.when(explicit.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), explicit.cast("int")))).otherwise(by_type)


def severity_label(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def is_auth_failure(event_type: Column, data: Column) -> Column:
    kind = F.upper(event_type)
    token = F.upper(F.coalesce(F.get_json_object(data, "$.event"), F.get_json_object(data, "$.status"), F.lit("")))
    return kind.rlike("AUTH_FAIL|LOGIN_FAIL") | (
        (kind == "SECURITY_AUTH_EVENT") & (token.rlike(_FAIL) | F.upper(F.coalesce(data, F.lit(""))).rlike(_FAIL))
    )


def ioc_class(indicator: Column, threat_type: Column, message: Column) -> Column:
    """app, domain, phishing, permission or null: indicator first, then type, then text."""
    tag = F.lower(F.trim(F.coalesce(indicator, F.lit(""))))
    text = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    sensitive = text.contains("camera") | text.contains("microphone") | text.contains("location")
    return (
        F.when(tag.startswith("app:"), "app")
        .when(tag.startswith("domain:"), "domain")
        .when(tag.startswith("phishing:"), "phishing")
        .when(tag.startswith("perm:"), "permission")
        .when(F.upper(F.coalesce(threat_type, F.lit(""))) == "PHISHING", "phishing")
        .when(text.contains("known malicious app activity detected"), "app")
        .when(text.contains("known malicious website detected"), "domain")
        .when(text.contains("phishing") | text.contains("suspicious website"), "phishing")
        .when(text.contains("permission") & sensitive, "permission")
    )


IOC_MODES: dict[str, Sequence[str] | None] = {
    "all": None, "ioc": ("app", "domain"), "ioc-app": ("app",), "ioc-domain": ("domain",),
}


def filter_ioc(df: DataFrame, mode: str = "all", column: str = "ioc_type") -> DataFrame:
    kinds = IOC_MODES[mode]
    return df if kinds is None else df.filter(F.col(column).isin(*kinds))


def payload_preview(data: Column, width: int = 180) -> Column:
    return F.when(F.coalesce(data, F.lit("")) == "", "No payload").otherwise(F.substring(data, 1, width))


def weak_label(level: Column) -> Column:
    return level.isin("W", "E", "F").cast("int")


def ioc_modes(ioc_type: Column) -> Column:
    """Every feed mode a row belongs to, so that all feeds come from one pass."""
    member = [
        F.when(F.lit(True) if kinds is None else ioc_type.isin(*kinds), F.lit(mode)) for mode, kinds in IOC_MODES.items()
    ]
    return F.array_compact(F.array(*member))
