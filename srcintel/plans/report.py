"""Reports of issues: human, JSON, SARIF, Markdown. Rows are shaped in Spark; the driver lays out what it prints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.operators.deadcode import ordered
from srcintel.operators.post import DESCRIPTIONS, SMELLS, detail, level, sarif_rows

FORMATS = ("human", "json", "sarif", "markdown")
_FIELDS = {
    "unused-file": "path", "unused-import": "path line name module", "unused-dep": "path name source", "duplicate": "token_count occurrences", "complexity": "path line function cyclomatic cognitive",
    "low-maintainability": "path mi_score avg_cyclomatic loc", "hotspot": "path cyclomatic churn hotspot_score", "circular-dependency": "cycle", "refactor-target": "path line function cyclomatic cognitive effort",
    "feature-flag": "path line flag provider", "parse-error": "path message", **dict.fromkeys(SMELLS, "path line rule detail"),
}
#: Where the rules are explained, relative to this project.
HELP = "README.md"
_RENAMED = {"mi_score": "score", "hotspot_score": "score"}


def json_rows(issues: DataFrame) -> DataFrame:
    """rule, body: each issue as a JSON object with the fields of its type; smells have type `smell`."""
    out = None
    for rule, fields in _FIELDS.items():
        body = F.struct(F.lit("smell" if rule in SMELLS else rule).alias("type"), *[F.col(c).alias(_RENAMED.get(c, c)) for c in fields.split()])
        text = F.when(F.col("rule") == rule, F.to_json(body))
        out = text if out is None else F.coalesce(out, text)
    return issues.withColumn("body", out)


def as_json(issues: DataFrame, stats: dict) -> str:
    rows = ordered(json_rows(issues)).select("body").collect()
    return json.dumps({"issues": [json.loads(r["body"]) for r in rows], "stats": stats}, indent=2, ensure_ascii=False)


def as_sarif(issues: DataFrame, name: str = "srcintel", version: str = "0.1.0") -> str:
    shaped = ordered(sarif_rows(issues))
    none = F.lit(None).cast("int")
    places = F.when(F.col("rule") == "duplicate", F.transform("occurrences", lambda o: F.struct(o["path"].alias("path"), o["start_line"].alias("line"), o["end_line"].alias("end"))))
    places = places.when(F.col("rule") == "circular-dependency", F.transform("cycle", lambda p: F.struct(p.alias("path"), none.alias("line"), none.alias("end"))))
    places = places.otherwise(F.array(F.struct(F.col("path").alias("path"), F.col("line").alias("line"), none.alias("end"))))
    rows = shaped.select("rule", "rule_index", "level", "text", places.alias("places")).collect()

    def location(p) -> dict:
        physical: dict = {"artifactLocation": {"uri": p["path"]}}
        if p["line"] is not None:
            physical["region"] = {"startLine": p["line"], **({"endLine": p["end"]} if p["end"] is not None else {})}
        return {"physicalLocation": physical}

    rules = dict(sorted({(r["rule"], r["level"]) for r in rows}))
    catalogue = [
        {"id": r, "name": "".join(w.capitalize() for w in r.split("-")), "shortDescription": {"text": DESCRIPTIONS.get(r, r)}, "helpUri": f"{HELP}#rule-{r}", "defaultConfiguration": {"level": lv}}
        for r, lv in rules.items()
    ]
    results = []
    for r in rows:
        one = {"ruleId": r["rule"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": r["text"]}, "locations": [location(p) for p in r["places"][:1]]}
        if len(r["places"]) > 1:
            one["relatedLocations"] = [location(p) for p in r["places"][1:]]
        results.append(one)
    run = {"tool": {"driver": {"name": name, "version": version, "informationUri": HELP, "rules": catalogue}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def _lines(issues: DataFrame) -> list:
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    return ordered(issues).select("rule", place.alias("place"), detail().alias("text"), level(F.col("rule")).alias("level")).collect()


def as_markdown(issues: DataFrame, stats: dict) -> str:
    rows = _lines(issues)
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["rule"], []).append(r)
    out = ["# Report", "", "| Rule | Count |", "|---|---|", *(f"| `{k}` | {len(by[k])} |" for k in sorted(by)), f"| **Total** | **{len(rows)}** |", ""]
    for k in sorted(by):
        out += [f"## `{k}`", "", f"_{DESCRIPTIONS.get(k, k)}_", "", "| Location | Detail |", "|---|---|", *(f"| `{r['place']}` | {r['text']} |" for r in by[k]), ""]
    return "\n".join([*out, f"_{stats.get('files_scanned', 0)} files in {stats.get('elapsed_ms', 0)} ms._", ""])


def as_human(issues: DataFrame, stats: dict) -> str:
    rows = _lines(issues)
    if not rows:
        body = ["ok: no issues"]
    else:
        a, b = (max(len(r[c]) for r in rows) for c in ("rule", "place"))
        body = [f"{r['rule']:<{a}}  {r['place']:<{b}}  {r['text']}" for r in rows]
    return "\n".join([*body, f"{len(rows)} issues, {stats.get('files_scanned', 0)} files, {stats.get('elapsed_ms', 0)} ms"])


def render(issues: DataFrame, kind: str, stats: dict) -> str:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if kind == "sarif":
        return as_sarif(issues)
    return {"json": as_json, "markdown": as_markdown, "human": as_human}[kind](issues, stats)
