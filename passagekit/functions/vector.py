"""Vector expressions on ``array<float>`` columns (JVM higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sq_l2(a: Column, b: Column) -> Column:
    """Squared L2 distance, summed left to right in double precision."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of ``v`` as float; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))
    # the norm enters the lambda as a zipped argument: computed once per row
    z = F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n"))
    return F.transform(z, lambda e: F.when(e["n"] > 0, e["x"].cast("double") / e["n"])
                       .otherwise(F.lit(0.0)).cast("float"))
