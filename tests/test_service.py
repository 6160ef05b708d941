"""scan, check, fix and cleanup over a project of the example models, with views, a ledger, a manifest and another dialect."""

import json
import os
import time

import pytest

from twinplan import cli, config, report, service
from twinplan.examples import MODELS, POSTGRES
from twinplan.functions.dialect import time_format, to_spark
from twinplan.functions.identifiers import Refused
from twinplan.plans import compiled
from twinplan.plans.models import parse_model
from twinplan.sources import corpus, manifest, workspace
from twinplan.workload import _spark_relation

FOLDER = "/root/testdata/sf0.001"
resolve = _spark_relation(FOLDER)


@pytest.fixture()
def project(tmp_path):
    (tmp_path / "models" / "deep").mkdir(parents=True)
    (tmp_path / "dbt_project.yml").write_text("model-paths: [models, ../out]\nprofile: birds\n")
    for name, sql in MODELS.items():
        (tmp_path / "models" / "deep" / f"{name}.sql").write_text(sql)
    return tmp_path


FLOATING = {"narrow_names", "reused_wide"}  # of floating point columns, which are not compared
REFUSED = {"other_filter": "DIFFERENT_PREDICATE", "cut_without_order": "NONDETERMINISTIC", "narrow_rows": "NONDETERMINISTIC"}


def test_check(spark, project):
    found = {r.source_path.split("/")[-1][:-4]: r for r in service.check(spark, str(project), resolve)}
    expected = {k: ("unverifiable", "UNSUPPORTED_COMPARISON_TYPE") if k in FLOATING else ("unverifiable", REFUSED[k]) if k in REFUSED else ("snapshot_equivalent", "OK") for k in found}
    assert {k: (r.status, r.reason_codes[0]) for k, r in found.items()} == expected
    assert set(found) == set(MODELS) - {"shown_all", "volatile"}
    receipts = list(found.values())
    assert report.exit_code(receipts, "unverifiable") == 4 and report.exit_code(receipts, "never") == 0
    shown = json.loads(report.check_json(str(project), receipts))
    assert shown["summary"]["fixable"] == sum(r.fixable for r in receipts) == len(found) - len(FLOATING) - len(REFUSED)
    evidence = shown["models"][0]["evidence"]
    assert evidence["spark_version"].startswith("4") and evidence["tool_version"] and len(evidence["before_sha256"]) == 64


def test_fix_and_scan(spark, project, capsys):
    path = "models/deep/merge_two.sql"
    before = (project / path).read_bytes()
    assert service.fix(spark, str(project), path, resolve, dry_run=True).fixable and (project / path).read_bytes() == before
    receipt = service.fix(spark, str(project), path, resolve)
    assert (project / path).read_bytes() == receipt.candidate != before
    assert service.fix(spark, str(project), path, resolve).reason_codes == ("NO_DUPLICATE_IMPORT",)
    with pytest.raises(Refused, match="SOURCE_CHANGED_BEFORE_APPLY"):
        service.apply_verified(project / path, receipt.before_sha256, receipt.candidate, receipt.after_sha256)
    assert cli.main(["scan", "--project-dir", str(project), "--format", "json", "--fail-on", "finding"], spark) == 2
    found = json.loads(capsys.readouterr().out)["findings"]
    assert len(found) == len(MODELS) - 3 and all(f["source_path"].startswith("models/deep/") for f in found)
    assert cli.main(["scan", "--project-dir", str(project / "none"), "--format", "text"], spark) == 0


def pairs(**sql):
    return [service.Prepared(k, b"x", b"y", ("OK",), *v, "spark") for k, v in sql.items()]


def test_failures_are_told_apart_in_a_batch(spark):
    good, bad, fails = "SELECT 1 AS x", "SELECT * FROM no_such_table", "SELECT CAST(raise_error('no') AS INT) AS x"
    models = pairs(same=(good, good), other=(good, "SELECT 2 AS x"), named=(good, "SELECT 1 AS y"), model=(bad, good), ours=(good, bad), runs=(good, fails), floating=("SELECT 1D AS x", "SELECT 1D AS x"), theirs=(fails, good))
    got = {r.source_path: (r.status, r.reason_codes[0]) for r in service.verify(spark, models)}
    assert list(got) == [m.path for m in models]
    assert got == {
        "same": ("snapshot_equivalent", "OK"), "other": ("different", "BAG_DIFFERENCE"), "named": ("different", "SCHEMA_MISMATCH"), "model": ("error", "DBT_COMMAND_FAILED"), "ours": ("error", "COMPILE_DRIFT"),
        "runs": ("error", "COMPILE_DRIFT"), "floating": ("unverifiable", "UNSUPPORTED_COMPARISON_TYPE"), "theirs": ("error", "DBT_COMMAND_FAILED"),
    }


def test_views_are_made_and_dropped(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS scratch_tp")
    ledger = workspace.Ledger(tmp_path / "run" / "ledger.json")
    views = service.Views(spark, "scratch_tp", ledger)
    good, bad = "SELECT 1 AS x", "SELECT * FROM no_such_table"
    found = views.verify(pairs(same=(good, good), ours=(good, bad), other=(good, "SELECT 2 AS x")))
    assert [(r.status, r.reason_codes[0]) for r in found] == [("snapshot_equivalent", "OK"), ("error", "COMPILE_DRIFT"), ("different", "BAG_DIFFERENCE")]
    assert all(r.cleanup_complete and r.run_id == views.run_id and len(r.relations) == 2 for r in found) and found[0].fixable
    assert set(ledger.entries().values()) == {"dropped"} and len(ledger.entries()) == 6
    assert service.existing(spark, "scratch_tp", [n for r in found for n in r.relations]) == []
    run, other = service.new_run(), service.new_run()
    made = service.create_views(spark, "scratch_tp", run, "m", good, good)
    kept = service.create_views(spark, "scratch_tp", other, "m", good, good)
    with pytest.raises(Refused, match="there already"):
        service.Views(spark, "scratch_tp", run_id=run).verify(pairs(m=(good, good)))
    done = service.cleanup(spark, "scratch_tp", run)
    assert done["complete"] and done["dropped"] == sorted(made)
    assert service.cleanup(spark, "scratch_tp", other)["dropped"] == sorted(kept)
    spark.sql("DROP DATABASE scratch_tp")


def test_boundaries(monkeypatch):
    for bad in ("default", "A", "x-y", "pg_x", "", "x" * 64):
        with pytest.raises(Refused, match="SCRATCH_BOUNDARY_VIOLATION"):
            service.scratch_schema(bad)
    run = service.new_run()
    names = service.scratch_names(run, ["a", "b"])
    planned = [s for n in names.values() for s in service.view_statements("nest", n, ("SELECT 1", "WITH a AS (SELECT 1) SELECT 1"))]
    service.preflight("nest", planned, names)
    for wrong in (planned[:-1], [*planned, planned[0]], ["DROP VIEW x", *planned[1:]], [planned[0].replace("nest", "tree"), *planned[1:]]):
        with pytest.raises(Refused, match="SCRATCH_BOUNDARY_VIOLATION"):
            service.preflight("nest", wrong, names)
    for uids in (["a", "a"],):
        with pytest.raises(Refused, match="share a name"):
            service.scratch_names(run, uids)
    monkeypatch.setattr(service, "sha256", lambda data: "0" * 64)
    with pytest.raises(Refused, match="share a name"):
        service.scratch_names(run, ["a", "b"])


def test_jobs_are_stopped_after_their_time(spark):
    assert service.run_limited(spark, 60, lambda: spark.range(5).count()) == 5
    begun = time.monotonic()
    with pytest.raises(Refused, match="WAREHOUSE_TIMEOUT"):
        service.run_limited(spark, 1, lambda: _sleep(spark))
    assert time.monotonic() - begun < 35
    assert not spark.sparkContext.getJobTags()


def _sleep(spark):
    def wait(frames):
        for frame in frames:
            time.sleep(40)
            yield frame

    return spark.range(4).mapInPandas(wait, "id long").collect()


# --- manifests and compiled text ------------------------------------------------------


def node(uid, name, package="p", deps=(), kind="model", path=None):
    return {"unique_id": uid, "resource_type": kind, "name": name, "package_name": package, "original_file_path": path or f"models/{name}.sql", "depends_on": {"nodes": list(deps)}, "relation_name": f"`wh`.`{package}`.`{name}`"}


def test_manifest(spark, tmp_path):
    nodes = {n["unique_id"]: n for n in (node("model.p.a", "a", deps=["model.p.m", "model.q.m", "source.p.s.t"]), node("model.p.m", "m"), node("model.q.m", "m", "q"), node("model.p.z", "z"))}
    found = {"metadata": {"dbt_schema_version": "https://x/manifest/v12.json"}, "nodes": nodes, "sources": {"source.p.s.t": {"unique_id": "source.p.s.t", "name": "t", "source_name": "s", "package_name": "p"}}}
    (tmp_path / "m.json").write_text(json.dumps(found))
    graph = manifest.graph(spark, manifest.load(str(tmp_path / "m.json")))
    calls = [("model.p.a", "ref", None, "m", None), ("model.p.a", "ref", "q", "m", None), ("model.p.a", "source", None, "t", "s"), ("model.p.a", "ref", None, "z", None)]
    got = manifest.resolve(spark.createDataFrame(calls, "owner string, kind string, package string, name string, source_name string"), *graph)
    assert {(r["package"], r["name"]): (r["uid"], r["code"]) for r in got.collect()} == {
        (None, "m"): (None, "SOURCE_MAPPING_AMBIGUOUS"), ("q", "m"): ("model.q.m", "OK"), (None, "t"): ("source.p.s.t", "OK"), (None, "z"): (None, "SOURCE_MAPPING_AMBIGUOUS"),
    }
    for bad in ('{"a": 1, "a": 2}', '{"metadata": {"dbt_schema_version": "v9.json"}}', "[", json.dumps({**found, "nodes": {"x": node("y", "y")}})):
        (tmp_path / "m.json").write_text(bad)
        with pytest.raises(Refused, match="UNSUPPORTED_MANIFEST_SCHEMA"):
            manifest.load(str(tmp_path / "m.json"))


def test_check_resolves_by_the_manifest(spark, project):
    spark.read.parquet(f"{FOLDER}/orders.parquet").drop("o_totalprice").createOrReplaceTempView("held_orders")
    path = "models/deep/merge_two.sql"
    nodes = [node("model.p.merge_two", "merge_two", deps=["model.p.orders"], path=path), {**node("model.p.orders", "orders"), "relation_name": "held_orders"}, node("model.p.narrow_chain", "narrow_chain", path="models/deep/narrow_chain.sql")]
    found = {"nodes": {n["unique_id"]: n for n in nodes}}
    got = {r.source_path: (r.status, r.reason_codes[0]) for r in service.check(spark, str(project), None, found=found)}
    assert got[path] == ("snapshot_equivalent", "OK")
    assert got["models/deep/narrow_chain.sql"] == ("unverifiable", "SOURCE_MAPPING_AMBIGUOUS")
    assert service.fix(spark, str(project), path, None, dry_run=True, found=found).fixable


def test_compiled_entries(spark):
    assert compiled.strange_nodes(spark, "select a, b as c from s.t where a > 1 and not b is null and c in (1, 2) and cast(d as int) between 1 and 2") == []
    strange = {
        "select upper(a) from t": "function", "select a from t join u on true": "Join", "select distinct a from t": "Distinct", "select a from t limit 1": "GlobalLimit", "select * from t": "UnresolvedStar",
        "select a from t order by a": "Sort", "select a from t where a in (select 1)": "InSubquery", "select a, count(1) from t group by a": "Aggregate", "select a + 1 as a from t": "Add", "select 1 as a": "OneRowRelation",
    }
    for body, word in strange.items():
        assert any(word in x for x in compiled.strange_nodes(spark, body)), (body, compiled.strange_nodes(spark, body))
    source = parse_model(MODELS["merge_filtered"].encode())
    sql = service.render(MODELS["merge_filtered"].encode(), lambda call: f"wh.{call.name}")
    matched = compiled.match_entries(spark, source, sql)
    assert [(m.entry.name.value, m.relation) for m in matched] == [("first", "wh.customer"), ("second", "wh.customer")]
    assert [codes for _, codes in compiled.compiled_groups(source, matched)] == [()]
    once = sql.replace("wh.customer", "wh.other", 1)
    assert compiled.compiled_groups(source, compiled.match_entries(spark, source, once))[0][1][0] == "SOURCE_MAPPING_AMBIGUOUS"
    for wrong, code in ((sql.replace("second", "third"), "SOURCE_MAPPING_AMBIGUOUS"), (sql.replace("c_name as label", "c_name as tag"), "SOURCE_MAPPING_AMBIGUOUS"), (sql.replace("c_name as label", "upper(c_name) as label"), "UNSUPPORTED_IMPORT_SHAPE")):
        with pytest.raises(Refused, match=code):
            compiled.match_entries(spark, source, wrong)


def test_tree_fingerprints(spark):
    same = compiled.tree_fingerprint(spark, "select a from t where a = 100 and b = 1")
    assert same == compiled.tree_fingerprint(spark, "SELECT  A -- first\nFROM t WHERE a = 100 AND b=1")
    others = ("select a from t where a = 100.0 and b = 1", "select a from t where b = 1 and a = 100", "select a from t where 100 = a and b = 1", "select a from u where a = 100 and b = 1", "select a from t where a = 101 and b = 1")
    assert len({same, *(compiled.tree_fingerprint(spark, x) for x in others)}) == 6


@pytest.mark.parametrize(("sql", "code"), [("", "NEEDS_COMPILED_ANALYSIS"), ("select {{ x }}", "NEEDS_COMPILED_ANALYSIS"), ("create view v as select 1", "UNSUPPORTED_MODEL_TYPE"), ("insert into t select 1", "UNSUPPORTED_MODEL_TYPE"), ("show tables", "UNSUPPORTED_MODEL_TYPE")])
def test_what_is_no_query(spark, sql, code):
    with pytest.raises(Refused, match=code):
        compiled.parsed(spark, sql)


# --- PostgreSQL's SQL ------------------------------------------------------------------


def test_postgres_models_are_checked_in_translation(spark, project):
    sql = "with a as (select o_orderkey, o_custkey ^ 2 as \"K\" from {{ ref('orders') }}), b as (select o_orderkey, o_orderdate from {{ ref('orders') }}), c as (select o_orderkey, o_orderstatus from {{ ref('orders') }}) select b.o_orderkey::int as k, to_char(b.o_orderdate, 'YYYY') as y, concat(c.o_orderstatus, null, 'it''s') as s from b join c on b.o_orderkey = c.o_orderkey"
    receipt = service.check_model(spark, "m.sql", sql.encode(), resolve, "postgres")
    assert (receipt.status, receipt.reason_codes, receipt.dialect) == ("snapshot_equivalent", ("OK",), "postgres")
    assert service.check_model(spark, "m.sql", sql.replace("'it''s'", "to_char(1.5, '9.99')").encode(), resolve, "postgres").reason_codes == ("UNSUPPORTED_FUNCTION",)
    for text in ("'a\\'", '"a"'):
        got = service.check_model(spark, "m.sql", sql.replace('"K"', "k").replace("'it''s'", text).encode(), resolve, "spark")
        assert got.reason_codes == ("HARNESS_EMBEDDING_UNSAFE",)


@pytest.mark.parametrize(("ours", "spelled"), [
    ("a ^ b", "power(a, b)"), ("1 - 2 ^ 3 * 4", "1 - power(2, 3) * 4"), ("-(x) ^ 2", "power(-(x), 2)"), ("x ^ -y", "power(x, -y)"), ("log(x) + ln(y)", "log10(x) + ln(y)"), ("log(2, x)", "log(2, x)"),
    ("a::text::varchar(3)", "CAST(CAST(a AS STRING) AS VARCHAR(3))"), ('"a""b".c', '`a"b`.c'), ("strpos(a, b)", "instr(a, b)"), ("to_timestamp(5)", "timestamp_seconds(5)"), ("to_number(x, '99D9')", "to_number(x, '99D9')"),
    ("$$it's \\ $$", "'it\\'s \\\\ '"), ("localtime", "current_time()"), ("count(*)", "count(*)"), ("t.log(x)", "t.log(x)"), ("current_timestamp", "current_timestamp"),
])
def test_spelling(ours, spelled):
    squeeze = lambda x: "".join(x.split())
    assert squeeze(to_spark(f"select {ours} from u")) == squeeze(f"select {spelled} from u")


def test_formats():
    assert time_format('FMDay, DD "of" Month YYYY HH12:MI:SS.US AM'.removeprefix("FM")) == "EEEE, dd 'of' MMMM yyyy hh:mm:ss.SSSSSS a"
    assert time_format("YYYYQ") == "yyyyq"
    for bad in ("WW", "J", '"open'):
        with pytest.raises(Refused, match="UNSUPPORTED_FUNCTION"):
            time_format(bad)
    for sql in ("select to_char(x, f) from t", "select trunc(x, 2) from t", "select strpos(x) from t"):
        with pytest.raises(Refused, match="UNSUPPORTED_FUNCTION"):
            to_spark(sql)
    assert set(POSTGRES) >= {"times", "clock"}


def test_projects_in_a_store_that_spark_reads(spark, project):
    here = {r["source_path"] for r in corpus.discover(spark, str(project)).select("source_path").collect()}
    assert here == {f"models/deep/{n}.sql" for n in MODELS}
    assert {r["source_path"] for r in corpus.discover(spark, f"file://{project}").select("source_path").collect()} == here
    assert corpus.discover(spark, f"file://{project}/models/deep").count() == 0


# --- files -----------------------------------------------------------------------------


def test_guarded_reads(tmp_path):
    root = tmp_path / "p"
    (root / "models").mkdir(parents=True)
    (root / "models" / "a.sql").write_text("a")
    (root / "link.sql").symlink_to(root / "models" / "a.sql")
    (tmp_path / "outside.sql").write_text("x")
    (root / "out.sql").symlink_to(tmp_path / "outside.sql")
    (root / "gone.sql").symlink_to(root / "nothing.sql")
    os.mkfifo(root / "pipe.sql")
    assert workspace.read_inside(root, "link.sql") == b"a"
    for bad in ("out.sql", "gone.sql", "pipe.sql", "models", "../outside.sql", "none"):
        with pytest.raises(Refused, match="SOURCE_CHANGED_DURING_SNAPSHOT"):
            workspace.read_inside(root, bad)


def test_snapshots_and_digests(tmp_path, monkeypatch):
    root = tmp_path / "p"
    for name, text in {"models/a.sql": "a", "models/target/b.sql": "b", "target/c.sql": "c", "models/__pycache__/d.pyc": "d", "macros/m.sql": "m", "dbt_project.yml": "name: p"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (tmp_path / "shared").mkdir()
    (tmp_path / "shared" / "e.sql").write_text("e")
    (root / "dbt_packages").mkdir()
    (root / "dbt_packages" / "s").symlink_to(tmp_path / "shared")
    copy, digest = workspace.snapshot(root, tmp_path / "copy")
    assert sorted(p.relative_to(copy).as_posix() for p in copy.rglob("*") if p.is_file()) == ["dbt_packages/s/e.sql", "dbt_project.yml", "macros/m.sql", "models/a.sql", "models/target/b.sql"]
    assert workspace.snapshot(root)[1] == digest
    before = workspace.package_digest(root)
    (root / "models" / "a.sql").write_text("other")
    assert workspace.package_digest(root) == before and workspace.snapshot(root)[1] != digest
    (root / "macros" / "m.sql").write_text("other")
    assert workspace.package_digest(root) != before
    found = iter([{"a": b"1"}, {"a": b"2"}])
    monkeypatch.setattr(workspace, "_contents", lambda root: next(found))
    with pytest.raises(Refused, match="SOURCE_CHANGED_DURING_SNAPSHOT"):
        workspace.snapshot(root, tmp_path / "again")
    assert not (tmp_path / "again").exists()
    monkeypatch.undo()
    (root / "models" / "linked").symlink_to(tmp_path / "shared")
    with pytest.raises(Refused, match="linked folder"):
        workspace.snapshot(root)


def test_ledger(tmp_path):
    ledger = workspace.Ledger(tmp_path / "l.json")
    for name, state in (("a", "recorded"), ("b", "recorded"), ("a", "dropped"), ("b", "cleanup_failed")):
        ledger.record(name, state)
    assert ledger.entries() == {"a": "dropped", "b": "cleanup_failed"}
    with pytest.raises(Refused):
        ledger.record("a", "lost")
    (tmp_path / "l.json").write_text("[]")
    with pytest.raises(Refused):
        ledger.entries()


def test_profiles_and_agreement(tmp_path):
    (tmp_path / "dbt_project.yml").write_text("profile: birds\n")
    (tmp_path / "profiles.yml").write_text("birds:\n  target: day\n  outputs:\n    day: {type: spark}\n    night: {type: postgres}\n")
    assert workspace.project_profile(tmp_path) == "birds" and workspace.profile_dialect(tmp_path, "birds") == "spark" and workspace.profile_dialect(tmp_path, "birds", "night") == "postgres"
    assert workspace.profile_dialect(tmp_path, "fish") is None and workspace.profile_dialect(tmp_path / "none", "birds") is None
    given = {"profiles_dir": None, "target": None}
    c = config.load({"project_dir": str(tmp_path)}, {})
    assert cli.dialect_of(c, None, given) == "spark" and cli.dialect_of(c, {"metadata": {"adapter_type": "Spark"}}, given) == "spark"
    assert cli.dialect_of(c, None, {**given, "target": "night"}) == "postgres"
    with pytest.raises(Refused, match="ADAPTER_MISMATCH"):
        cli.dialect_of(c, {"metadata": {"adapter_type": "postgres"}}, given)
    (tmp_path / "profiles.yml").write_text("birds: [")
    assert workspace.profile_dialect(tmp_path, "birds") is None
    with pytest.raises(Refused, match="UNSUPPORTED_ADAPTER"):
        cli.dialect_of(c, {"metadata": {"adapter_type": "oracle"}}, given)


def test_command_line_checks_through_views(spark, project, capsys):
    for file in (project / "models" / "deep").iterdir():
        if file.stem != "merge_two":
            file.unlink()
    spark.read.parquet(f"{FOLDER}/orders.parquet").write.saveAsTable("held_orders", mode="overwrite")
    spark.sql("CREATE DATABASE IF NOT EXISTS scratch_cli")
    (project / "models" / "deep" / "merge_two.sql").write_text(MODELS["merge_two"].replace("'orders'", "'orders'"))
    code = cli.main(["check", "--project-dir", str(project), "--relation-prefix", "default.held_", "--scratch-schema", "scratch_cli", "--ledger", str(project / "l.json"), "--format", "json", "--fail-on", "fixable"], spark)
    shown = json.loads(capsys.readouterr().out)["models"][0]
    assert code == 2 and shown["fixable"] and shown["cleanup_complete"] and len(shown["evidence"]["relations"]) == 2
    assert set(workspace.Ledger(project / "l.json").entries().values()) == {"dropped"}
    spark.sql("DROP DATABASE scratch_cli")
    spark.sql("DROP TABLE held_orders")


def test_settings(tmp_path):
    (tmp_path / "twinplan.toml").write_text('fail_on = "fixable"\nformat = "json"\n')
    c = config.load({"project_dir": str(tmp_path), "format": "text"}, {"TWINPLAN_FAIL_ON": "different"})
    assert (c.format, c.fail_on, c.dialect) == ("text", "different", None)
    with pytest.raises(Refused):
        config.load({"project_dir": str(tmp_path), "fail_on": "sometimes"}, {})
    assert corpus.model_paths(str(tmp_path)) == ["models"]
