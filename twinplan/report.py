"""Reports of scans and checks as text, JSON and annotations, and the exit code they give."""

from __future__ import annotations

import json
from dataclasses import asdict

from twinplan.service import Receipt

SCHEMA_VERSION = "1"
#: Thresholds from the mildest, and the exit code of each; `never` is above all.
LEVELS = {"finding": 2, "fixable": 2, "different": 3, "unverifiable": 4}
_OF_STATUS = {"snapshot_equivalent": "fixable", "different": "different", "unverifiable": "unverifiable", "error": "unverifiable"}


def level(receipt: Receipt) -> str | None:
    if receipt.status == "not_run":
        return None if receipt.reason_codes == ("NO_DUPLICATE_IMPORT",) else "finding"
    return _OF_STATUS[receipt.status]


def exit_code(receipts: list[Receipt], fail_on: str) -> int:
    """The worst level's code where it reaches the threshold, else 0."""
    order = list(LEVELS)
    reached = [order.index(x) for x in map(level, receipts) if x is not None]
    if fail_on == "never" or not reached or max(reached) < order.index(fail_on):
        return 0
    return LEVELS[order[max(reached)]]


def scan_json(project: str, rows: list) -> str:
    found = [
        {"source_path": r["source_path"], "upstream_unique_id": r["upstream"], "cte_names": list(r["entries"]), "status": r["status"], "reason_codes": list(r["reason_codes"]), "line": r["line"]}
        for r in rows
    ]
    return json.dumps({"schema_version": SCHEMA_VERSION, "command": "scan", "project_dir": project, "summary": {"findings": len(found)}, "findings": found}, indent=2)


def check_json(project: str, receipts: list[Receipt], command: str = "check") -> str:
    ordered = sorted(receipts, key=lambda r: r.source_path)
    count = lambda s: sum(r.status == s for r in ordered)
    summary = {
        "models_scanned": len(ordered), "findings": count("snapshot_equivalent"), "fixable": sum(r.fixable for r in ordered),
        "different": count("different"), "unverifiable": count("unverifiable"), "errors": count("error"),
    }
    models = [
        {"source_path": r.source_path, "status": r.status, "reason_codes": list(r.reason_codes), "fixable": r.fixable, "equality": asdict(r.equality), "diff": r.diff,
         "evidence": {"before_sha256": r.before_sha256, "after_sha256": r.after_sha256, "baseline_sha256": r.baseline_sha256, "candidate_sha256": r.candidate_sha256,
                      "dialect": r.dialect, "run_id": r.run_id, "relations": list(r.relations), "tool_version": r.tool_version, "spark_version": r.spark_version},
         "cleanup_complete": r.cleanup_complete, "detail": r.detail}
        for r in ordered
    ]
    return json.dumps({"schema_version": SCHEMA_VERSION, "command": command, "project_dir": project, "summary": summary, "models": models, "cleanup": {"complete": all(r.cleanup_complete for r in ordered)}}, indent=2)


def _said(r) -> str:
    return f"{', '.join(r['entries'])}: {r['upstream']} ({', '.join(r['reason_codes'])})"


def scan_text(rows: list) -> str:
    return "".join(f"{r['source_path']}:{r['line']}: {_said(r)}\n" for r in rows)


def _escaped(text: str, inside: bool = False) -> str:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if inside else ())):
        text = text.replace(a, b)
    return text


def scan_annotations(rows: list) -> str:
    return "".join(f"::warning file={_escaped(r['source_path'], True)},line={r['line']}::{_escaped(_said(r))}\n" for r in rows)


def check_text(receipts: list[Receipt]) -> str:
    out = []
    for r in sorted(receipts, key=lambda r: r.source_path):
        out.append(f"{r.source_path}: {r.status} ({', '.join(r.reason_codes)}){' fixable' if r.fixable else ''}\n{r.diff}")
    return "".join(out)
