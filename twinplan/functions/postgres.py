"""Functions whose Spark namesakes mean something else than in PostgreSQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def log(x: Column) -> Column:
    """To base 10."""
    return F.log10(x)


def concat(*parts: Column) -> Column:
    """Null parts are left out."""
    return F.concat_ws("", *parts)


def to_integer(x: Column) -> Column:
    """Rounds half away from zero, where Spark's cast cuts off."""
    return F.round(x).cast("int")


def date_trunc(unit: str, x: Column) -> Column:
    """Without a zone in, without a zone out."""
    return F.date_trunc(unit, x).cast("timestamp_ntz")


def extract(part: str, x: Column) -> Column:
    return F.floor(F.date_part(F.lit(part), x)).cast("long")
