"""Reports of one dataset's issues as text, JSON or HTML; formatting happens on the driver, over the issues of one document.

A report of more than one dataset raises.  dataset names the one that is reported, so that a valid one, which has no issues, lists all rules as passed.
"""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derive import D
from .validate import rule_results

ORDER = ("rule", "code", "object_id", "detail")


def _rows(issues: DataFrame, dataset: str | None) -> tuple[list, list]:
    known = None
    if dataset is not None:
        issues = issues.where(F.col(D) == dataset)
        known = issues.sparkSession.createDataFrame([(dataset,)], f"{D} string")
    results = sorted((r for r in rule_results(issues, known).collect()), key=lambda r: (r[D], r.ord))
    if len({r[D] for r in results}) > 1:
        raise ValueError("a report is of one dataset: name it")
    return results, issues.orderBy(*ORDER).collect()


def _issue(r) -> dict:
    message = " ".join(x for x in (f"{r.code}:", r.object_id or "", (r.detail or "").replace("|", ", ")) if x)
    return {"rule": r.rule, "code": r.code, "severity": r.severity, "objectId": r.object_id, "message": message, "detail": r.detail}


def to_json(issues: DataFrame, dataset: str | None = None) -> str:
    results, rows = _rows(issues, dataset)
    errors = sum(r.severity == "error" for r in rows)
    of = lambda rule: [_issue(r) for r in rows if r.rule == rule]
    body = {
        "valid": errors == 0,
        "issueCount": len(rows),
        "errorCount": errors,
        "ruleResults": [{"id": r.rule, "name": r["name"], "conformanceClass": r["class"], "status": r.status, "issueCount": r.issues, "errorCount": r.errors, "issues": of(r.rule)} for r in results],
        "issues": [_issue(r) for r in rows],
    }
    return json.dumps(body, indent=2, ensure_ascii=False)


def to_text(issues: DataFrame, dataset: str | None = None) -> str:
    """Status, counts, the rules by class, then the issues."""
    results, rows = _rows(issues, dataset)
    errors = sum(r.severity == "error" for r in rows)
    out = [f"Result: {'INVALID' if errors else 'VALID'}", f"Errors: {errors}, warnings: {len(rows) - errors}"]
    for group in dict.fromkeys(r["class"] for r in results):
        out += ["", group or "Structure", *(f"  {r.status:4} {r.rule:9} {r['name']} ({r.issues})" for r in results if r["class"] == group)]
    out += ["", *(f"[{r.severity}] {_issue(r)['message']}" for r in rows)]
    return "\n".join(out) + "\n"


def to_html(issues: DataFrame, title: str = "Topology report", dataset: str | None = None) -> str:
    results, rows = _rows(issues, dataset)
    cell = lambda *xs: "<tr>" + "".join(f"<td>{html.escape(str(x if x is not None else ''))}</td>" for x in xs) + "</tr>"
    head = lambda *xs: "<tr>" + "".join(f"<th>{x}</th>" for x in xs) + "</tr>"
    rules = "".join(cell(r.rule, r["name"], r["class"], r.status, r.issues) for r in results)
    found = "".join(cell(r.severity, r.code, r.object_id, r.detail) for r in rows) or cell("", "no issues", "", "")
    at = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
    return (
        f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
        f"<p>{at}: {len(rows)} issues</p><table>{head('Rule', 'Name', 'Class', 'Status', 'Issues')}{rules}</table>"
        f"<table>{head('Severity', 'Code', 'Object', 'Detail')}{found}</table></body></html>\n"
    )
