"""Reason codes, dialects and how each folds identifiers."""

from __future__ import annotations

from dataclasses import dataclass

# Names of dialects and how unquoted identifiers fold there.
FOLDS = {
    "postgres": "lower",
    "snowflake": "upper",
    "duckdb": "lower",
    "bigquery": "lower",
    "databricks": "lower",
    "redshift": "lower",
    "materialize": "lower",
    "trino": "lower",
    "presto": "lower",
    "athena": "lower",
    "spark": "lower",
    "sqlite": "lower",
    "tsql": "lower",
    "oracle": "upper",
    "exasol": "upper",
    "clickhouse": "none",
}
#: Dialects in which this package can prove a rewrite: Spark runs them, PostgreSQL's after translation.
VERIFIES = ("spark", "databricks", "postgres")


class Refused(Exception):
    """An input outside of what is understood, with the reason's code."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


@dataclass(frozen=True)
class Identifier:
    source_text: str
    value: str
    quoted: bool
    identity: str


def fold(value: str, quoted: bool, rule: str) -> str:
    """The spelling that tells identifiers apart: `insensitive` folds quoted names as well."""
    if rule == "insensitive":
        return value.lower()
    if quoted or rule == "none":
        return value
    return value.upper() if rule == "upper" else value.lower()


def identifier(text: str, rule: str = "lower") -> Identifier:
    quoted = text[:1] in ('"', "`")
    value = text[1:-1].replace(text[0] * 2, text[0]) if quoted else text
    return Identifier(text, value, quoted, fold(value, quoted, rule))


def dialect_fold(name: str) -> str:
    try:
        return FOLDS[name.strip().lower()]
    except KeyError:
        raise Refused("UNSUPPORTED_ADAPTER", name) from None


def resolve_dialect(*named: str | None) -> str:
    """The dialect that the sources name: the first one decides, and any that names another is an error."""
    given = [n.strip().lower() for n in named if n]
    if not given:
        raise Refused("UNSUPPORTED_ADAPTER", "no dialect is named")
    dialect_fold(given[0])
    if set(given) != {given[0]}:
        raise Refused("ADAPTER_MISMATCH", ", ".join(given))
    return given[0]
