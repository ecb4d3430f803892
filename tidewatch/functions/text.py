"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals, rounded by the exact binary value (ties to even), as C and Python print.

    ``format_string`` rounds the shortest decimal text half up, which differs near ties. Here
    the product with the scale is split into value and error, so the side of a tie is exact.
    """
    scale = 10**digits

    def parts(x: Column) -> Column:
        return F.struct(F.floor(x).alias("whole"), (x - F.floor(x)).alias("f"))

    def text(v: Column) -> Column:
        f, steps = v["f"], F.floor(v["f"] * scale)
        high = f * 134217729.0 - (f * 134217729.0 - f)
        product = f * (2.0 * scale)
        error = (high * (2.0 * scale) - product) + (f - high) * (2.0 * scale)
        side = (product - (steps * 2 + 1)) + error
        up = F.when((side > 0) | ((side == 0) & (steps % 2 == 1)), 1).otherwise(0)
        return F.format_string(f"%.{digits}f", v["whole"] + (steps + up) / float(scale))

    body = F.get(F.transform(F.transform(F.array(F.abs(value).cast("double")), parts), text), F.lit(0))
    return F.when(value < 0, F.concat(F.lit("-"), body)).otherwise(body)
