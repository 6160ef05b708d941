"""scan, check, fix and cleanup.

check proves each candidate on the tables themselves: baseline and candidate run
in one query and are compared as bags, the pairs of a batch in one job. One
model's failure does not touch others.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import re
import secrets
import stat
import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from itertools import islice
from pathlib import Path

import pyspark
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from twinplan import __version__
from twinplan.functions.dialect import to_spark
from twinplan.functions.identifiers import Refused, dialect_fold
from twinplan.functions.lexer import RelationCall, decode, mask, plain, tokenize
from twinplan.operators.compare import Equality, compare, compare_all, quote
from twinplan.plans import demand
from twinplan.plans.compiled import refuse_commands
from twinplan.plans.determinism import refusals
from twinplan.plans.models import parse_model
from twinplan.plans.rewrite import Edit, apply_edits, plan_merge, unified_diff
from twinplan.sources import corpus, manifest
from twinplan.sources.workspace import Ledger

Resolve = Callable[[RelationCall], str]
RUN_ID = re.compile(r"[0-9a-f]{16}")
SCHEMA_NAME = re.compile(r"[a-z_][a-z0-9_]*")
FORBIDDEN_SCHEMAS = frozenset({"default", "public", "information_schema", "pg_catalog", "global_temp", "sys"})
#: Pairs that one job compares; its plan grows with them.
BATCH = 16
#: Dialects in which a backslash escapes in strings or a double quote makes one, which the lexer reads otherwise.
OTHER_STRINGS = frozenset({"spark", "databricks", "bigquery"})


@dataclass(frozen=True)
class Receipt:
    """The evidence for one model."""

    source_path: str
    status: str
    reason_codes: tuple[str, ...]
    equality: Equality = Equality(False)
    before_sha256: str = ""
    after_sha256: str = ""
    baseline_sha256: str = ""
    candidate_sha256: str = ""
    diff: str = ""
    candidate: bytes = field(default=b"", repr=False)
    cleanup_complete: bool = True
    detail: str = ""
    dialect: str = "spark"
    run_id: str = ""
    relations: tuple[str, ...] = ()
    tool_version: str = __version__
    spark_version: str = pyspark.__version__

    @property
    def fixable(self) -> bool:
        """The only state in which a file may be changed."""
        e = self.equality
        none_differ = not e.baseline_only_occurrences and not e.candidate_only_occurrences
        return self.status == "snapshot_equivalent" and self.reason_codes == ("OK",) and self.cleanup_complete and e.schema_equal and none_differ and e.baseline_rows == e.candidate_rows


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def render(raw: bytes, resolve: Resolve, dialect: str = "spark") -> str:
    """The SQL that Spark runs: calls become relations; comments and a leading config() go; other tags are refused.

    A model in PostgreSQL's SQL is translated, so that it means the same here.
    """
    text = decode(raw).text
    masked, out, at = mask(text), [], 0
    calls = {c.start: c for c in masked.calls.values()}
    for t in masked.tags:
        out.append(text[at : t.start])
        if t.start in calls:
            out.append(resolve(calls[t.start]))
        elif t.kind != "comment" and not text[t.start + 2 : t.end].lstrip("-+ \r\n\t").startswith("config("):
            raise Refused("NEEDS_COMPILED_ANALYSIS", "a tag makes SQL")
        at = t.end
    sql = "".join([*out, text[at:]]).strip()
    sql = sql[:-1] if sql.endswith(";") else sql
    ts = plain(tokenize(sql))
    if not ts or any(t.text == ";" for t in ts):
        raise Refused("HARNESS_EMBEDDING_UNSAFE", "not one statement")
    if dialect in OTHER_STRINGS and any(t.text[:1] == '"' or t.kind == "string" and ("\\" in t.text or t.text[0] == "$") for t in ts):
        raise Refused("HARNESS_EMBEDDING_UNSAFE", "a string that is read in another way")
    return to_spark(sql) if dialect == "postgres" else sql


def parse_query(spark: SparkSession, sql: str) -> str:
    """The root of the parsed plan's name. Raises unless the text is one query."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    refuse_commands(spark, plan)
    return plan.getClass().getSimpleName()


def source_edits(before: bytes, after: bytes) -> list[Edit]:
    """What turns a file into its candidate, by lines, as edits of the file's text; they are checked by applying them."""
    a, b = decode(before).text, decode(after).text
    old, new = a.splitlines(keepends=True), b.splitlines(keepends=True)
    starts = [0]
    for line in old:
        starts.append(starts[-1] + len(line))
    found = SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    edits = [Edit(starts[i], starts[j], "".join(new[k:m])) for kind, i, j, k, m in found if kind != "equal"]
    if apply_edits(a, edits) != b:
        raise Refused("INTERNAL_ERROR", "the edits do not give the candidate")
    return edits


def candidate_of(raw: bytes, rule: str = "lower") -> tuple[bytes, tuple[str, ...]]:
    """The file after narrowing and merging, and why it could not be merged. Raises NO_DUPLICATE_IMPORT where nothing can change."""
    narrowed, found = demand.prune(raw, rule)
    try:
        return plan_merge(narrowed, rule).candidate, ("OK",)
    except Refused as e:
        if not found:
            raise
        return narrowed, ("OK",) if e.code in ("NO_DUPLICATE_IMPORT", "DIFFERENT_PREDICATE", "PROJECTION_COLLISION") else (e.code,)


@dataclass(frozen=True)
class Prepared:
    """A model that can be verified: its candidate, and both as Spark's SQL."""

    path: str
    raw: bytes
    candidate: bytes
    codes: tuple[str, ...]
    before: str
    after: str
    dialect: str

    def receipt(self, status: str, codes: tuple[str, ...], equality: Equality = Equality(False), detail: str = "") -> Receipt:
        edited = decode(self.raw).encode(apply_edits(decode(self.raw).text, source_edits(self.raw, self.candidate)))
        return Receipt(
            self.path, status, codes, equality, sha256(self.raw), sha256(edited), sha256(self.before.encode()), sha256(self.after.encode()),
            unified_diff(self.path, self.raw, edited), edited, detail=detail, dialect=self.dialect,
        )


def prepare(spark: SparkSession, path: str, raw: bytes, resolve: Resolve, dialect: str = "spark") -> Prepared | Receipt:
    """All that is done with a model before its rows are read: the gates, the candidate, and that both are one query."""
    rule = dialect_fold(dialect)
    try:
        if why := refusals(parse_model(raw, rule).masked.text, rule):
            raise Refused("NONDETERMINISTIC", "; ".join(why))
        candidate, codes = candidate_of(raw, rule)
        before, after = render(raw, resolve, dialect), render(candidate, resolve, dialect)
        parse_query(spark, before)
    except Refused as e:
        return Receipt(path, "not_run" if e.code == "NO_DUPLICATE_IMPORT" else "unverifiable", (e.code,), before_sha256=sha256(raw), detail=e.detail, dialect=dialect)
    except PySparkException as e:
        return Receipt(path, "unverifiable", ("DBT_COMMAND_FAILED",), before_sha256=sha256(raw), detail=f"the model as it is: {e}", dialect=dialect)
    return Prepared(path, raw, candidate, codes, before, after, dialect)


def verify(spark: SparkSession, models: list[Prepared]) -> list[Receipt]:
    """Receipts in the order given. All pairs are compared in one job; where that fails, each alone.

    A model that fails as it is, is told apart from a candidate that fails where its model does not: that is our fault.
    """
    pairs, out = {}, {}
    for m in models:
        try:
            pairs[m.path] = [spark.sql(m.before)]
            pairs[m.path].append(spark.sql(m.after))
        except PySparkException as e:
            ours = len(pairs.pop(m.path, [])) == 1
            out[m.path] = m.receipt("error", ("COMPILE_DRIFT" if ours else "DBT_COMMAND_FAILED",), detail=f"{'the candidate alone' if ours else 'the model as it is'}: {e}")
    found = compare_all({path: tuple(p) for path, p in pairs.items()})
    for m in models:
        if m.path in out:
            continue
        equality = found[m.path]
        if isinstance(equality, TypeError):
            out[m.path] = m.receipt("unverifiable", ("UNSUPPORTED_COMPARISON_TYPE",), detail=str(equality))
        elif isinstance(equality, Exception):
            out[m.path] = m.receipt("error", ("COMPILE_DRIFT" if _runs(pairs[m.path][0]) else "DBT_COMMAND_FAILED",), detail=str(equality))
        elif equality.status == "SNAPSHOT_EQUIVALENT":
            out[m.path] = m.receipt("snapshot_equivalent", m.codes, equality)
        else:
            out[m.path] = m.receipt("different", ("BAG_DIFFERENCE" if equality.schema_equal else "SCHEMA_MISMATCH",), equality)
    return [out[m.path] for m in models]


def _runs(df: DataFrame) -> bool:
    try:
        df.write.format("noop").mode("overwrite").save()
        return True
    except PySparkException:
        return False


def check_models(spark: SparkSession, models: Iterable[tuple[str, bytes]], resolve: Callable[[str], Resolve], dialect: str = "spark", batch: int = BATCH,
                 views: Views | None = None) -> Iterator[Receipt]:
    """A receipt for each (path, content), in order, a batch at a time."""
    waiting = iter(models)
    while some := list(islice(waiting, batch)):
        ready = [prepare(spark, path, raw, resolve(path), dialect) for path, raw in some]
        prepared = [m for m in ready if isinstance(m, Prepared)]
        found = iter(views.verify(prepared) if views is not None else verify(spark, prepared))
        yield from [next(found) if isinstance(m, Prepared) else m for m in ready]


def check_model(spark: SparkSession, path: str, raw: bytes, resolve: Resolve, dialect: str = "spark") -> Receipt:
    return next(check_models(spark, [(path, raw)], lambda _: resolve, dialect))


def resolvers(spark: SparkSession, models: DataFrame, found: dict) -> Callable[[str], Resolve]:
    """For each file, which relation a call of its names, by the manifest: the one node among the file's own dependencies, else the call is refused.

    Calls and nodes are joined by Spark; the result has a row for each call of a manifest that the driver holds anyway.
    """
    nodes, edges = manifest.graph(spark, found)
    owners = nodes.filter("kind = 'ref'").selectExpr("uid as owner", "path as source_path")
    calls = corpus.relation_calls(models).join(owners, "source_path").select("source_path", "owner", "kind", "package", "name", "source_name").distinct()
    named = calls.select("source_path", "owner").distinct().join(manifest.resolve(calls, nodes, edges), "owner").join(nodes.select("uid", "relation"), "uid", "left")
    table = {(r["source_path"], r["kind"], r["package"], r["name"], r["source_name"]): (r["code"], r["relation"]) for r in named.collect()}

    def of(path: str) -> Resolve:
        def resolve(call: RelationCall) -> str:
            code, relation = table.get((path, call.kind, call.package, call.name, call.source_name), ("SOURCE_MAPPING_AMBIGUOUS", None))
            if code != "OK" or not relation:
                raise Refused("SOURCE_MAPPING_AMBIGUOUS", f"{path}: {call.name}")
            return relation

        return resolve

    return of


def scan(spark: SparkSession, project: str, rule: str = "lower") -> DataFrame:
    return corpus.findings(corpus.discover(spark, project), rule).orderBy("source_path", "line")


def check(spark: SparkSession, project: str, resolve: Resolve | None, dialect: str = "spark", only: str | None = None, found: dict | None = None,
          views: Views | None = None) -> list[Receipt]:
    """A receipt for each file that a scan has a lead on; files without one are not read again. Calls are resolved by a manifest where one is given."""
    models = corpus.discover(spark, project)
    leads = corpus.findings(models, dialect_fold(dialect)).select("source_path").distinct()
    if only is not None:
        leads = leads.filter(leads.source_path == only)
    of = resolvers(spark, models, found) if found is not None else lambda _: resolve
    rows = models.join(leads, "source_path").orderBy("source_path").toLocalIterator()
    return list(check_models(spark, ((r["source_path"], bytes(r["content"])) for r in rows), of, dialect, views=views))


def fix(spark: SparkSession, project: str, path: str, resolve: Resolve | None, dialect: str = "spark", dry_run: bool = False, found: dict | None = None) -> Receipt:
    root = Path(project).resolve()
    target = (root / path).resolve()
    if not target.is_relative_to(root):
        raise Refused("INTERNAL_ERROR", "the path leaves the project")
    raw = target.read_bytes()
    if found is not None:
        resolve = resolvers(spark, spark.createDataFrame([(path, raw)], "source_path string, content binary"), found)(path)
    receipt = check_model(spark, path, raw, resolve, dialect)
    if receipt.fixable and not dry_run:
        apply_verified(target, receipt.before_sha256, receipt.candidate, receipt.after_sha256)
    return receipt


def run_limited(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """Runs jobs under a tag of their own and stops them, and nothing else, once the time is over."""
    sc, tag, over, ended = spark.sparkContext, f"twinplan-{secrets.token_hex(8)}", threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(seconds):
            return
        over.set()
        while True:  # a job may start after its time is over
            sc.cancelJobsWithTag(tag)
            if ended.wait(0.2):
                return

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    watcher.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise Refused("WAREHOUSE_TIMEOUT", f"{seconds} s") from e
        raise
    finally:
        ended.set()
        watcher.join()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)


def apply_verified(path: Path, before_sha256: str, candidate: bytes, after_sha256: str) -> None:
    """Replaces a file in one step, if it still is what was checked and the new text is what was proven."""
    if sha256(candidate) != after_sha256:
        raise Refused("INTERNAL_ERROR", "the candidate is not the one that was checked")
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    except OSError as e:
        raise Refused("SOURCE_CHANGED_BEFORE_APPLY", str(e)) from e
    with os.fdopen(fd, "rb") as held:
        fcntl.flock(held, fcntl.LOCK_EX)
        if sha256(held.read()) != before_sha256:
            raise Refused("SOURCE_CHANGED_BEFORE_APPLY")
        mode = stat.S_IMODE(os.fstat(held.fileno()).st_mode)
        with tempfile.NamedTemporaryFile(dir=path.parent, prefix=".new-", delete=False) as new:
            new.write(candidate)
            new.flush()
            os.fsync(new.fileno())
        try:
            os.chmod(new.name, mode)
            if sha256(path.read_bytes()) != before_sha256:
                raise Refused("SOURCE_CHANGED_BEFORE_APPLY")
            os.replace(new.name, path)
        finally:
            Path(new.name).unlink(missing_ok=True)
    folder = os.open(path.parent, os.O_RDONLY)
    os.fsync(folder)
    os.close(folder)


# --- scratch views ---------------------------------------------------------------


def scratch_schema(name: str, model_schema: str | None = None) -> str:
    if not SCHEMA_NAME.fullmatch(name) or len(name) > 63 or name in FORBIDDEN_SCHEMAS or name.startswith("pg_") or name == model_schema:
        raise Refused("SCRATCH_BOUNDARY_VIOLATION", name)
    return name


def new_run() -> str:
    return secrets.token_hex(8)


def view_names(run_id: str, uid: str) -> tuple[str, str]:
    token = f"{run_id}_{sha256(uid.encode())[:8]}"
    return f"tp_baseline_{token}", f"tp_candidate_{token}"


def scratch_names(run_id: str, uids: list[str]) -> dict[str, tuple[str, str]]:
    """The names of all pairs of a run; two models with one name are refused."""
    if not RUN_ID.fullmatch(run_id):
        raise Refused("SCRATCH_BOUNDARY_VIOLATION", run_id)
    names = {uid: view_names(run_id, uid) for uid in uids}
    if len(set(names.values())) != len(set(uids)) or len(names) != len(uids):
        raise Refused("SCRATCH_BOUNDARY_VIOLATION", "two models share a name")
    return names


def existing(spark: SparkSession, schema: str, names: Iterable[str]) -> list[str]:
    """Which of the names the schema has already, views and tables alike."""
    wanted = {n.lower() for n in names}
    rows = spark.sql(f"SHOW TABLES IN {quote(schema)}").collect() + spark.sql(f"SHOW VIEWS IN {quote(schema)}").collect()
    return sorted({name for r in rows if not r["isTemporary"] and (name := (r["tableName"] if "tableName" in r else r["viewName"])).lower() in wanted})


def preflight(schema: str, planned: list[str], names: dict[str, tuple[str, str]]) -> None:
    """The statements to be run make exactly the expected views, each once, in the scratch schema, and do nothing else."""
    pattern = re.compile(r"CREATE VIEW `([^`]+)`\.`([^`]+)` AS (?:SELECT|WITH)\b.*", re.I | re.S)
    made = [pattern.fullmatch(s) for s in planned]
    if any(m is None or m[1] != schema for m in made):
        raise Refused("SCRATCH_BOUNDARY_VIOLATION", "a statement that makes no view in the scratch schema")
    if sorted(m[2] for m in made) != sorted(n for pair in names.values() for n in pair):
        raise Refused("SCRATCH_BOUNDARY_VIOLATION", "not the views that were expected")


def view_statements(schema: str, name_pair: tuple[str, str], sql_pair: tuple[str, str]) -> list[str]:
    return [f"CREATE VIEW {quote(schema)}.{quote(name)} AS {sql}" for name, sql in zip(name_pair, sql_pair)]


def create_views(spark: SparkSession, schema: str, run_id: str, uid: str, baseline: str, candidate: str) -> tuple[str, str]:
    """The pair of a model as views in the scratch schema."""
    names = scratch_names(run_id, [uid])
    planned = view_statements(scratch_schema(schema), names[uid], (baseline, candidate))
    preflight(schema, planned, names)
    for statement in planned:
        spark.sql(statement)
    return names[uid]


@dataclass
class Views:
    """Verification through views in a scratch schema: all pairs are made, compared in one job and dropped, whatever happens; a ledger keeps what was made."""

    spark: SparkSession
    schema: str
    ledger: Ledger | None = None
    run_id: str = field(default_factory=new_run)

    def verify(self, models: list[Prepared]) -> list[Receipt]:
        schema, spark = scratch_schema(self.schema), self.spark
        names = scratch_names(self.run_id, [m.path for m in models])
        planned = {m.path: view_statements(schema, names[m.path], (m.before, m.after)) for m in models}
        preflight(schema, [s for pair in planned.values() for s in pair], names)
        if there := existing(spark, schema, [n for pair in names.values() for n in pair]):
            raise Refused("SCRATCH_BOUNDARY_VIOLATION", f"there already: {', '.join(there)}")
        failed: dict[str, Receipt] = {}
        try:
            for m in models:
                for k, (name, statement) in enumerate(zip(names[m.path], planned[m.path])):
                    self._note(name, "recorded")
                    try:
                        spark.sql(statement)
                    except PySparkException as e:
                        failed[m.path] = m.receipt("error", ("COMPILE_DRIFT" if k else "DBT_COMMAND_FAILED",), detail=str(e))
                        break
            good = [m for m in models if m.path not in failed]
            over = [replace(m, before=f"SELECT * FROM {quote(schema)}.{quote(names[m.path][0])}", after=f"SELECT * FROM {quote(schema)}.{quote(names[m.path][1])}") for m in good]
            found = dict(zip([m.path for m in good], verify(spark, over)))
        finally:
            left = self.drop([n for pair in names.values() for n in pair])
        out = []
        for m in models:
            own = tuple(n for n in names[m.path])
            r = failed.get(m.path) or found[m.path]
            texts = {"baseline_sha256": sha256(m.before.encode()), "candidate_sha256": sha256(m.after.encode())}
            out.append(replace(r, run_id=self.run_id, relations=own, cleanup_complete=not set(own) & set(left), **texts))
        return out

    def drop(self, names: list[str]) -> list[str]:
        """Drops views of these names and says which are still there."""
        for name in names:
            try:
                self.spark.sql(f"DROP VIEW IF EXISTS {quote(self.schema)}.{quote(name)}")
            except PySparkException:
                continue
        left = existing(self.spark, self.schema, names)
        for name in names:
            self._note(name, "cleanup_failed" if name in left else "dropped")
        return left

    def _note(self, name: str, state: str) -> None:
        if self.ledger is not None:
            self.ledger.record(f"{self.schema}.{name}", state)


def cleanup(spark: SparkSession, schema: str, run_id: str) -> dict:
    """Drops the views of one run, and nothing else; says which are left."""
    if not RUN_ID.fullmatch(run_id):
        raise Refused("SCRATCH_BOUNDARY_VIOLATION", run_id)
    pattern = re.compile(rf"tp_(?:baseline|candidate)_{run_id}_[0-9a-f]{{8}}")
    schema = scratch_schema(schema)

    def own() -> list[str]:
        rows = spark.sql(f"SHOW VIEWS IN `{schema}`").collect()
        return sorted(r["viewName"] for r in rows if not r["isTemporary"] and pattern.fullmatch(r["viewName"]))

    names = own()
    for name in names:
        spark.sql(f"DROP VIEW IF EXISTS `{schema}`.`{name}`")
    left = own()
    return {"run_id": run_id, "dropped": [n for n in names if n not in left], "remaining": left, "complete": not left}
