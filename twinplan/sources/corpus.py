"""Model files as a DataFrame, and what a scan finds in them.

Each file is judged on its own in mapInPandas; nothing is collected.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.functions.identifiers import Refused
from twinplan.plans.compiled import compiled_duplicates
from twinplan.plans.demand import narrowings, prune
from twinplan.plans.determinism import refusals
from twinplan.plans.models import called_twice, duplicate_groups, fingerprint, group_codes, parse_model
from twinplan.plans.rewrite import plan_merge

FINDINGS = "source_path string, upstream string, entries array<string>, status string, reason_codes array<string>, line int"
CALLS = "source_path string, kind string, package string, name string, source_name string, version string, start int, stop int, line int"
ENTRIES = "source_path string, entry string, ordinal int, upstream string, columns array<string>, filtered boolean, readers int"
COMPILED = "source_path string, relation string, entries array<string>, plain boolean"
CANDIDATES = "source_path string, code string, narrowed array<string>, candidate string"
REASONS = "source_path string, upstream string, entries array<string>, reason_codes array<string>"
PRINTS = "source_path string, entry string, print string"
GATE = "source_path string, deterministic boolean, reasons array<string>"


def model_paths(project: str) -> list[str]:
    """The project file's model-paths; `models` where it has none that can be used."""
    try:
        return _listed_paths((Path(project) / "dbt_project.yml").read_bytes())
    except OSError:
        return ["models"]


def _listed_paths(content: bytes) -> list[str]:
    import yaml

    try:
        found = yaml.safe_load(content.decode("utf-8"))["model-paths"]
        return found if found and all(isinstance(p, str) and p for p in found) else ["models"]
    except (yaml.YAMLError, KeyError, TypeError, UnicodeDecodeError):
        return ["models"]


def discover(spark: SparkSession, project: str) -> DataFrame:
    """source_path (within the project) and content of all *.sql files under the model paths; paths that leave the project are left out.

    A project may lie in a store that only Spark reads (a folder with a scheme); one without a scheme must be seen by all executors.
    """
    if "://" in project:
        return _discover_remote(spark, project.rstrip("/"))
    root = os.path.realpath(project)
    inside = [p for p in (os.path.realpath(os.path.join(root, m)) for m in model_paths(project)) if os.path.commonpath([p, root]) == root and os.path.isdir(p)]
    if not inside:
        return spark.createDataFrame([], "source_path string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").option("recursiveFileLookup", True).load([f"file://{p}" for p in inside])
    relative = F.regexp_replace(F.col("path"), f"^file:/+{root.strip('/')}/", "")
    return files.select(relative.alias("source_path"), "content").dropDuplicates(["source_path"])


def _discover_remote(spark: SparkSession, project: str) -> DataFrame:
    binary = lambda: spark.read.format("binaryFile")
    listed = binary().option("pathGlobFilter", "dbt_project.yml").load(project).select("content").take(1)
    paths = _listed_paths(bytes(listed[0]["content"])) if listed else ["models"]
    inside = [p.strip("/") for p in paths if ".." not in p.split("/") and "://" not in p]
    there = [p for p in inside if _exists(spark, f"{project}/{p}")]
    if not there:
        return spark.createDataFrame([], "source_path string, content binary")
    files = binary().option("pathGlobFilter", "*.sql").option("recursiveFileLookup", True).load([f"{project}/{p}" for p in there])
    # a path is shown with its scheme and with one slash or three, so what follows the project's own path counts
    own = re.sub(r"^[A-Za-z][\w+.-]*:/*", "", project)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:/*", ""), f"^{re.escape(own)}/", "")
    return files.select(relative.alias("source_path"), "content").dropDuplicates(["source_path"])


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def _shown(call) -> str:
    return ".".join(str(x) for x in (call.source_name or call.package, call.name, call.version) if x is not None)


def lead(path: str, raw: bytes, rule: str) -> dict | None:
    """What a scan says of a file: columns that nobody reads, else its first duplicate import, else nothing."""
    try:
        model = parse_model(raw, rule)
    except Refused:
        return None
    row = lambda call, names, code, start: {
        "source_path": path, "upstream": _shown(call), "entries": names, "status": "needs_compiled_analysis", "reason_codes": [code], "line": model.decoded.line_at(start),
    }
    if found := narrowings(model):
        first = found[0].entry
        return row(first.call, [n.entry.name.value for n in found], "UNUSED_IMPORT_COLUMNS", first.start)
    twice = called_twice(model)
    if not twice:
        return None
    call, plain_imports = twice[0]
    members = [e for e in model.entries if any(t.text in model.masked.calls and model.masked.calls[t.text].key == call.key for t in e.body)]
    code = "NEEDS_COMPILED_ANALYSIS" if plain_imports else "UNSUPPORTED_IMPORT_SHAPE"
    return row(call, [e.name.value for e in members], code, members[0].start)


def _each(frames: Iterator[pd.DataFrame], rows, schema: str) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in schema.split(", ")]
    for frame in frames:
        out = [r for path, raw in zip(frame["source_path"], frame["content"]) for r in rows(path, bytes(raw or b""))]
        yield pd.DataFrame(out, columns=names)


def findings(models: DataFrame, rule: str = "lower") -> DataFrame:
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=partial(_leads, rule=rule), schema=FINDINGS), FINDINGS)


def _leads(path: str, raw: bytes, rule: str) -> list[dict]:
    found = lead(path, raw, rule)
    return [] if found is None else [found]


def relation_calls(models: DataFrame) -> DataFrame:
    """The literal calls of each file, at byte offsets; files that cannot be read have none."""
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=_calls, schema=CALLS), CALLS)


def _calls(path: str, raw: bytes) -> list[dict]:
    try:
        m = parse_model(raw)
    except Refused:
        return []
    d = m.decoded
    return [
        {"source_path": path, "kind": c.kind, "package": c.package, "name": c.name, "source_name": c.source_name, "version": None if c.version is None else str(c.version),
         "start": d.byte_at(c.start), "stop": d.byte_at(c.end), "line": d.line_at(c.start)}
        for c in m.masked.calls.values()
    ]


def imports(models: DataFrame, rule: str = "lower") -> DataFrame:
    """The imports of each file: columns (`*` for all), whether they filter, and how many places read them."""
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=partial(_imports, rule=rule), schema=ENTRIES), ENTRIES)


def _imports(path: str, raw: bytes, rule: str) -> list[dict]:
    try:
        m = parse_model(raw, rule)
    except Refused:
        return []
    return [
        {"source_path": path, "entry": e.name.value, "ordinal": e.ordinal, "upstream": _shown(e.call), "columns": ["*"] if e.star else [p.output.value for p in e.projections],
         "filtered": bool(e.predicate), "readers": sum(r.entry == e.name.identity for r in m.readers)}
        for e in m.entries if e.call is not None
    ]


def compiled_imports(models: DataFrame, rule: str = "lower") -> DataFrame:
    """Of compiled queries: relations that several entries import, with those entries in order, and whether all are plain imports."""
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=partial(_compiled, rule=rule), schema=COMPILED), COMPILED)


def _compiled(path: str, raw: bytes, rule: str) -> list[dict]:
    try:
        found = compiled_duplicates(raw.decode("utf-8"), rule)
    except (Refused, UnicodeDecodeError):
        return []
    return [{"source_path": path, "relation": r, "entries": list(names), "plain": ok} for r, names, ok in found]


def candidates(models: DataFrame, rule: str = "lower") -> DataFrame:
    """Each file after narrowing and merging, the entries that were narrowed, and the code of what kept it from being merged (OK where nothing did)."""
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=partial(_candidates, rule=rule), schema=CANDIDATES), CANDIDATES)


def _candidates(path: str, raw: bytes, rule: str) -> list[dict]:
    try:
        narrow, found = prune(raw, rule)
    except Refused as e:
        return [{"source_path": path, "code": e.code, "narrowed": [], "candidate": None}]
    try:
        out, code = plan_merge(narrow, rule).candidate, "OK"
    except Refused as e:
        out, code = narrow, e.code
    return [{"source_path": path, "code": code, "narrowed": [n.entry.name.value for n in found], "candidate": out.decode("utf-8")}]


def group_reasons(models: DataFrame, rule: str = "lower") -> DataFrame:
    """The groups of imports of one relation, and all reasons against merging each, in their order."""
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=partial(_reasons, rule=rule), schema=REASONS), REASONS)


def _reasons(path: str, raw: bytes, rule: str) -> list[dict]:
    try:
        m = parse_model(raw, rule)
        pure = not refusals(m.masked.text, rule)
    except Refused:
        return []
    return [
        {"source_path": path, "upstream": _shown(g.call), "entries": [e.name.value for e in g.members], "reason_codes": list(group_codes(m, g, pure))} for g in duplicate_groups(m)
    ]


def predicate_prints(models: DataFrame, rule: str = "lower") -> DataFrame:
    """The fingerprint of each import's predicate; none where it has none."""
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=partial(_prints, rule=rule), schema=PRINTS), PRINTS)


def _prints(path: str, raw: bytes, rule: str) -> list[dict]:
    try:
        m = parse_model(raw, rule)
    except Refused:
        return []
    return [{"source_path": path, "entry": e.name.value, "print": fingerprint(e.predicate, rule) if e.predicate else None} for e in m.entries if e.call is not None]


def determinism(models: DataFrame) -> DataFrame:
    return models.select("source_path", "content").mapInPandas(partial(_each, rows=_gate, schema=GATE), GATE)


def _gate(path: str, raw: bytes) -> list[dict]:
    try:
        m = parse_model(raw)
        why = refusals(m.masked.text, m.rule)
    except Refused as e:
        why = [e.code]
    return [{"source_path": path, "deterministic": not why, "reasons": why}]


def duplicate_imports(found: DataFrame) -> DataFrame:
    """From imports(): upstream relations that a file imports twice or more, with their entries in order."""
    one = F.sort_array(F.collect_list(F.struct("ordinal", "entry")))
    return found.groupBy("source_path", "upstream").agg(one.alias("members")).filter(F.size("members") > 1).select("source_path", "upstream", F.col("members.entry").alias("entries"))
