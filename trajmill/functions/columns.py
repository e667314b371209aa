"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def number(c) -> Column:
    """A double, or null where the text is no number."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def seconds(c) -> Column:
    """Seconds since the epoch of a date or timestamp column."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) / F.lit(1e6)


def is_missing(c: str, floating: bool) -> Column:
    missing = F.col(c).isNull()
    return missing | F.isnan(c) if floating else missing


def floating_columns(df: DataFrame) -> set[str]:
    return {name for name, kind in df.dtypes if kind in ("double", "float")}


def clip(c: Column, bound: float) -> Column:
    return F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), c))


def dot(weights, columns) -> Column:
    """Sum of constant times column; zero weights drop out of the expression."""
    terms = [F.lit(float(w)) * (F.col(c) if isinstance(c, str) else c) for w, c in zip(weights, columns) if w != 0.0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "state", value: str = "value",
         keep_null: bool = True) -> DataFrame:
    """Wide to long with doubles; null cells stay unless ``keep_null`` is off."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    long = cast.unpivot(ids, values, name, value)
    return long if keep_null else long.where(F.col(value).isNotNull())


def slug(text: str) -> str:
    """A name fit for a key: other characters than letters, digits, dot, dash and underscore become _."""
    return re.sub(r"[^\w.-]", "_", str(text).strip()).strip("._") or "model"
