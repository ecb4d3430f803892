"""Schemaless JSON payloads as typed columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import PAYLOAD_DDL


def parse_payload(df: DataFrame, source: str = "data", target: str = "p") -> DataFrame:
    """Adds the payload as one struct of text fields; anything but a JSON object gives nulls.

    One pass over the JSON serves every key, and the optimizer prunes unused keys.
    """
    text = F.when(F.ltrim(F.col(source)).startswith("{"), F.col(source))
    return df.withColumn(target, F.from_json(text, PAYLOAD_DDL))


def num(value: Column, default: float | None = None) -> Column:
    """Text as a double; the default where it is missing or not a number."""
    out = value.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def truthy(value: Column) -> Column:
    """true, 1, yes and numbers other than zero are true; the text "false" is not."""
    text = F.lower(F.trim(value))
    return F.coalesce(text.isin("true", "yes") | (F.coalesce(text.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


def csv_tokens(setting: Column) -> Column:
    """"a, B ,," -> [a, b]: trimmed lower-case tokens, blanks dropped."""
    return F.array_distinct(
        F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    )


def text_list(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")
