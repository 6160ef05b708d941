"""Compiled queries: what a template makes is only seen there.

The text is read as model files are, with each plain relation behind FROM in the
place of a literal call; Catalyst's parse tree tells what an entry is made of.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from twinplan.functions.dialect import to_spark
from twinplan.functions.identifiers import Refused, identifier
from twinplan.functions.lexer import plain, tokenize
from twinplan.plans.models import Entry, Group, Model, called_twice, duplicate_groups, group_codes, is_name, parse_model

#: Nodes of a parse tree that an import may have: columns, aliases, one relation, comparisons and their connectives, literals, casts.
IMPORT_NODES = frozenset(
    "Project Filter UnresolvedRelation UnresolvedAttribute Alias Literal EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not In Between UnresolvedBetween "
    "IsNull IsNotNull IsTrue IsFalse Cast UnaryMinus".split()
)
#: Functions that the parser leaves unresolved for what SQL spells with words.
IMPORT_FUNCTIONS = frozenset({"between"})
#: Fields of a tree's nodes that tell where something stands, or that are made anew on each parse.
_POSITION = frozenset({"origin", "exprId", "planId", "resultId", "id", "evalMode", "timeZoneId", "nonInheritableMetadataKeys", "explicitMetadata", "metadata"})


def parsed(spark: SparkSession, sql: str, dialect: str = "spark") -> list:
    """The nodes of Catalyst's parse tree of one query. Blank text, leftover template marks, several statements and all that is no query are refused."""
    if not sql.strip() or re.search(r"\{\{|\{%|%\}|\}\}", sql):
        raise Refused("NEEDS_COMPILED_ANALYSIS", "not a compiled query")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(to_spark(sql) if dialect == "postgres" else sql)
    refuse_commands(spark, plan)
    return json.loads(plan.toJSON())


def refuse_commands(spark: SparkSession, plan) -> None:
    load = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
    for name in ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement"):
        if load(name).isInstance(plan):
            raise Refused("UNSUPPORTED_MODEL_TYPE", plan.getClass().getSimpleName())


def nodes(tree) -> list[dict]:
    """All nodes of a tree, with those of the expressions in them."""
    out, waiting = [], [tree]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            if isinstance(x.get("class"), str):
                out.append(x)
            waiting += list(x.values())
        elif isinstance(x, list):
            waiting += x
    return out


def strange_nodes(spark: SparkSession, body: str, dialect: str = "spark") -> list[str]:
    """What an entry's body has that no import has; empty for an import."""
    found = nodes(parsed(spark, body, dialect))
    names = [n["class"].rsplit(".", 1)[-1].rstrip("$") for n in found]
    out = sorted({n for n in names if n not in IMPORT_NODES and n != "UnresolvedFunction"})
    called = [str(n.get("nameParts")) for n, name in zip(found, names) if name == "UnresolvedFunction"]
    out += sorted(f"function {c}" for c in called if c.strip("[]'\" ").lower() not in IMPORT_FUNCTIONS)
    if names.count("UnresolvedRelation") != 1 or names.count("Project") != 1:
        out.append("not one relation")
    return out


def tree_fingerprint(spark: SparkSession, sql: str, dialect: str = "spark") -> str:
    """Equal for texts with equal parse trees but for case of names and places; 100 and 100.0, or swapped operands, differ."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in sorted(x.items()) if k not in _POSITION and v not in (None, [], "")}
        if isinstance(x, list):
            return [bare(v) for v in x]
        return x

    text = json.dumps(bare(parsed(spark, sql, dialect)), sort_keys=True)
    # names are folded, values are not: a literal's value stands beside its type
    folded = re.sub(r'("(?:nameParts|multipartIdentifier|name)": )("(?:[^"\\]|\\.)*"|\[[^\]]*\])', lambda m: m[1] + m[2].lower(), text)
    return hashlib.sha256(folded.encode()).hexdigest()


def as_model(sql: str, rule: str = "lower") -> Model:
    """A compiled query as a model: each relation behind FROM that is no entry's name stands as a literal call of that name."""
    ts = plain(tokenize(sql))
    own = {identifier(ts[i].text, rule).identity for i in range(len(ts) - 2) if is_name(ts[i]) and ts[i + 1].upper == "AS" and ts[i + 2].text == "("}
    edits, i = [], 0
    while i + 1 < len(ts):
        if ts[i].upper == "FROM" and is_name(ts[i + 1]):
            j = i + 1
            while j + 2 < len(ts) and ts[j + 1].text == "." and is_name(ts[j + 2]):
                j += 2
            if (j > i + 1 or identifier(ts[j].text, rule).identity not in own) and not (j + 1 < len(ts) and ts[j + 1].text == "("):
                name = ".".join(identifier(t.text, rule).identity for t in ts[i + 1 : j + 1 : 2])
                edits.append((ts[i + 1].start, ts[j].end, "{{ source('relation', " + json.dumps(name, ensure_ascii=False) + ") }}"))
            i = j
        i += 1
    for start, end, new in reversed(edits):
        sql = sql[:start] + new + sql[end:]
    return parse_model(sql.encode(), rule)


@dataclass(frozen=True)
class Matched:
    """An import of a file and the relation that its compiled entry reads."""

    entry: Entry
    relation: str


def match_entries(spark: SparkSession, source: Model, compiled_sql: str, dialect: str = "spark") -> list[Matched]:
    """Each import of a file with its compiled entry of the same name; as many columns of the same names, and a predicate on both sides or on neither."""
    compiled = as_model(compiled_sql, source.rule)
    by_name = {e.name.identity: e for e in compiled.entries}
    out = []
    for e in source.entries:
        if not e.supported:
            continue
        c = by_name.get(e.name.identity)
        if c is None:
            raise Refused("SOURCE_MAPPING_AMBIGUOUS", f"no compiled entry {e.name.value}")
        if c.call is None or c.star or strange_nodes(spark, _body(compiled, c), dialect):
            raise Refused("UNSUPPORTED_IMPORT_SHAPE", e.name.value)
        columns = lambda x: [(p.upstream.identity, p.output.identity) for p in x.projections]
        if columns(e) != columns(c) or bool(e.predicate) != bool(c.predicate):
            raise Refused("SOURCE_MAPPING_AMBIGUOUS", f"{e.name.value} is not what it is compiled to")
        out.append(Matched(e, c.call.name))
    return out


def _body(model: Model, e: Entry) -> str:
    """An entry's body with its relation spelled out."""
    text, calls = [], model.masked.calls
    for t in e.body:
        text.append(".".join(f"`{p}`" for p in calls[t.text].name.split(".")) if t.text in calls else t.text)
    return " ".join(text).replace(" . ", ".")


def compiled_groups(source: Model, matched: list[Matched], whole_model_ok: bool = True) -> list[tuple[Group, tuple[str, ...]]]:
    """The groups of a file's imports with the reasons against each; members that are compiled to different relations come first."""
    relation = {m.entry.name.identity: m.relation for m in matched}
    out = []
    for g in duplicate_groups(source):
        codes = group_codes(source, g, whole_model_ok)
        if len({relation.get(m.name.identity) for m in g.members}) > 1:
            codes = ("SOURCE_MAPPING_AMBIGUOUS", *(c for c in codes if c != "SOURCE_MAPPING_AMBIGUOUS"))
        out.append((g, codes))
    return out


def compiled_duplicates(compiled_sql: str, rule: str = "lower") -> list[tuple[str, tuple[str, ...], bool]]:
    """Relations that several entries of a compiled query import, with those entries, and whether all are plain imports: also those that templates make."""
    model = as_model(compiled_sql, rule)
    calls = model.masked.calls
    out = []
    for call, plain_imports in called_twice(model):
        members = tuple(e.name.value for e in model.entries if any(t.text in calls and calls[t.text].key == call.key for t in e.body))
        out.append((call.name, members, plain_imports))
    return out
