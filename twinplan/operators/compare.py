"""Proof that two relations are equal: exact ordered schema first, then rows as bags in one query.

Only types with exact equality are compared; floating point, nested and interval
types are refused before any row is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_TYPES = (
    T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType,
)
COUNTS = ("baseline_rows", "candidate_rows", "baseline_only_occurrences", "candidate_only_occurrences")


@dataclass(frozen=True)
class Equality:
    schema_equal: bool
    baseline_rows: int = 0
    candidate_rows: int = 0
    baseline_only_occurrences: int = 0
    candidate_only_occurrences: int = 0

    def __post_init__(self) -> None:
        values = [getattr(self, c) for c in COUNTS]
        if any(isinstance(v, bool) or not 0 <= v < 1 << 63 for v in values):
            raise ValueError("a count is out of range")
        if self.baseline_rows - self.baseline_only_occurrences != self.candidate_rows - self.candidate_only_occurrences:
            raise ValueError("the counts contradict one another")

    @classmethod
    def of_row(cls, row) -> Equality:
        """The counts of one row of COUNTS: neither more nor fewer, and whole numbers all."""
        found = row.asDict()
        if set(found) != set(COUNTS) or any(type(found[c]) is not int for c in COUNTS):
            raise ValueError(f"not a row of {', '.join(COUNTS)}")
        return cls(True, *(found[c] for c in COUNTS))

    @property
    def status(self) -> str:
        same = self.schema_equal and not self.baseline_only_occurrences and not self.candidate_only_occurrences
        return "SNAPSHOT_EQUIVALENT" if same else "DIFFERENT"


def declared_type(field: T.StructField) -> str:
    """The type as declared: char(n) and varchar(n) are only in the field's metadata."""
    return field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", field.dataType.simpleString())


def unsupported(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not isinstance(f.dataType, EXACT_TYPES)]


def schemas_equal(a: T.StructType, b: T.StructType) -> bool:
    """As many columns, of equal names and declared types, in the same order."""
    return [(f.name, declared_type(f)) for f in a.fields] == [(f.name, declared_type(f)) for f in b.fields]


def unused_name(base: str, taken: set[str]) -> str:
    while base.lower() in {t.lower() for t in taken}:
        base += "_"
    return base


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def grouped_verdict(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row of COUNTS. Each side is scanned once, with one exchange that is combined before it."""
    names = set(baseline.columns)
    side, delta = unused_name("side", names), unused_name("delta", names | {"side"})
    both = baseline.withColumn(side, F.lit(1).cast("long")).unionByName(candidate.withColumn(side, F.lit(-1).cast("long")))
    groups = both.groupBy(*[_quoted(c) for c in baseline.columns]).agg(
        F.sum(_quoted(side)).alias(delta), F.count_if(_quoted(side) > 0).alias("b"), F.count_if(_quoted(side) < 0).alias("c")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    d = _quoted(delta)
    return groups.select(d.alias("d"), "b", "c").agg(
        total(F.col("b")).alias(COUNTS[0]), total(F.col("c")).alias(COUNTS[1]),
        total(F.greatest(F.col("d"), F.lit(0))).alias(COUNTS[2]), total(F.greatest(-F.col("d"), F.lit(0))).alias(COUNTS[3]),
    )


def except_all_verdict(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """The same counts by two bag differences; for cross-checks, as it scans each side three times."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [one(baseline, COUNTS[0]), one(candidate, COUNTS[1]), one(baseline.exceptAll(candidate), COUNTS[2]), one(candidate.exceptAll(baseline), COUNTS[3])]
    keyed = [p.withColumn("k", F.lit(0)) for p in parts]
    out = keyed[0]
    for p in keyed[1:]:
        out = out.join(p, "k")
    return out.drop("k")


STRATEGIES = {"grouped_counts": grouped_verdict, "except_all": except_all_verdict}


def verdict(baseline: DataFrame, candidate: DataFrame, strategy: str = "grouped_counts") -> DataFrame:
    """One row of COUNTS by a strategy of that name; any other counts by groups."""
    return STRATEGIES.get(strategy, grouped_verdict)(baseline, candidate)


def gates(baseline: T.StructType, candidate: T.StructType) -> bool:
    """Whether the rows are to be compared at all: False for other schemas. Raises where a type cannot be compared."""
    for schema in (baseline, candidate):
        if bad := unsupported(schema):
            raise TypeError(f"UNSUPPORTED_COMPARISON_TYPE: {', '.join(bad)}")
    return schemas_equal(baseline, candidate)


def compare(baseline: DataFrame, candidate: DataFrame, strategy: str = "grouped_counts") -> Equality:
    """The gates, then the verdict."""
    return Equality.of_row(verdict(baseline, candidate, strategy).first()) if gates(baseline.schema, candidate.schema) else Equality(False)


def compare_all(pairs: dict[str, tuple[DataFrame, DataFrame]], strategy: str = "grouped_counts") -> dict[str, Equality | Exception]:
    """Several pairs in one job. Where that fails, each pair alone, so that a failure is its own; a pair that fails the gates reads no rows."""
    out: dict[str, Equality | Exception] = {}
    ready = {}
    for name, (baseline, candidate) in pairs.items():
        try:
            if gates(baseline.schema, candidate.schema):
                ready[name] = verdict(baseline, candidate, strategy)
            else:
                out[name] = Equality(False)
        except (TypeError, PySparkException) as e:
            out[name] = e
    if not ready:
        return out
    rows = [df.select(F.lit(name).alias("pair"), *COUNTS) for name, df in ready.items()]
    try:
        found = {r["pair"]: r for r in reduce(DataFrame.unionAll, rows).collect()}
        out |= {name: Equality(True, *(found[name][c] for c in COUNTS)) for name in ready}
    except PySparkException:
        for name, df in ready.items():
            try:
                out[name] = Equality.of_row(df.first())
            except PySparkException as e:
                out[name] = e
    return out


# --- names and literals in text that is run ------------------------------------------


def quote(name: str) -> str:
    """A name as an identifier of Spark's, whatever it holds."""
    if not name or "\0" in name:
        raise ValueError("not a name")
    return "`" + name.replace("`", "``") + "`"


def relation(text: str) -> str:
    """A relation of one to three quoted parts, and nothing else."""
    if not re.fullmatch(r"`(?:[^`\0]|``)+`(?:\.`(?:[^`\0]|``)+`){0,2}", text):
        raise ValueError(f"not a quoted relation: {text}")
    return text


def literal(value: str) -> str:
    """A string literal; a backslash or NUL is refused, as it would be read otherwise."""
    if "\\" in value or "\0" in value:
        raise ValueError("a literal with a backslash or NUL")
    return "'" + value.replace("'", "''") + "'"


# Other names of types, and the name that stands for each.
TYPE_NAMES = {
    "int2": "smallint",
    "int4": "int",
    "integer": "int",
    "int8": "bigint",
    "long": "bigint",
    "short": "smallint",
    "bool": "boolean",
    "text": "string",
    "character varying": "varchar",
    "character": "char",
    "numeric": "decimal",
    "dec": "decimal",
    "bytea": "binary",
    "timestamp without time zone": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "timestamptz": "timestamp",
}


def type_name(declared: str) -> str:
    """A declared type by the one name of its kind, its size kept."""
    text = " ".join(declared.lower().split())
    bare, size = (text[: text.index("(")].strip(), text[text.index("(") : text.rindex(")") + 1].replace(" ", "")) if "(" in text else (text, "")
    behind = text[text.rindex(")") + 1 :].strip() if "(" in text else ""
    whole = f"{bare} {behind}".strip()
    return TYPE_NAMES.get(whole, whole) + size


def ordered_schema(columns: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """Names and types of a catalogue's rows (place, name, declared type), in the order of their places."""
    return [(name, type_name(kind)) for _, name, kind in sorted(columns)]


def catalogue(spark: SparkSession, names: list[str]) -> dict[str, list[tuple[str, str]]]:
    """The ordered names and exact declared types of relations, as the catalogue has them."""
    return {n: ordered_schema([(i, f.name, declared_type(f)) for i, f in enumerate(spark.table(relation(n)).schema.fields)]) for n in names}
