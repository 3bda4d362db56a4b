"""After the analyses: noqa suppression, fingerprints and baselines, score, snapshots and trend, ownership, audit scope, fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcintel.functions.names import glob_regex
from srcintel.operators.facts import Facts
from srcintel.operators.health import lines
from srcintel.storage import stash

CODES = {"B006": "mutable-default", "BLE001": "broad-except", "E722": "broad-except", "S110": "broad-except", "S112": "broad-except", "E711": "sentinel-equality", "E712": "sentinel-equality", "T201": "stray-print", "T203": "stray-print", "F401": "unused-import"}
LEVELS = {"error": "unused-file low-maintainability circular-dependency parse-error money-as-float mutable-default raise-from-none", "warning": "unused-import unused-dep duplicate complexity hotspot broad-except unreachable-after-exit"}
DESCRIPTIONS = {
    "unused-file": "no entry point reaches the file", "unused-import": "the imported name isn't used", "unused-dep": "the dependency is never imported", "duplicate": "code that occurs in several files",
    "complexity": "the function is too complex", "low-maintainability": "the maintainability index is low", "hotspot": "complex and often changed", "circular-dependency": "modules that import each other",
    "refactor-target": "worth refactoring, by effort", "feature-flag": "a feature flag is read", "parse-error": "the file can't be parsed", "money-as-float": "money held in a float",
    "mutable-default": "a default that calls share", "raise-from-none": "the cause of an exception is dropped", "broad-except": "catches too much", "unreachable-after-exit": "nothing reaches the statement",
    "single-method-class": "a class that could be a function", "passthrough-function": "only hands its arguments on", "stray-print": "print in a library", "sentinel-equality": "== for None, True or False",
    "truthy-length-check": "a length compared with 0", "high-todo-density": "many TODO markers",
}
SMELLS = ["money-as-float", "mutable-default", "raise-from-none", "broad-except", "unreachable-after-exit", "single-method-class", "passthrough-function", "stray-print", "sentinel-equality", "truthy-length-check", "high-todo-density"]


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def level(rule: Column) -> Column:
    named = {r: lv for lv, rules in LEVELS.items() for r in rules.split()}
    return F.coalesce(lookup(named, rule), F.lit("note"))


# --- noqa -------------------------------------------------------------------------------------------------

#: What precedes a comment in a line: characters that are neither quotes nor #, escapes, and quoted parts; an open quote hides the rest.
_BEFORE = r"""^(?:[^'"#\\]|\\.|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")*"""


def comment(line: Column) -> Column:
    """The text after the # that begins a line's comment, trimmed; null without one."""
    return F.when(line.rlike(_BEFORE + "#"), F.trim(F.regexp_replace(line, _BEFORE + "#", "")))


def suppressions(f: Facts) -> DataFrame:
    """path, line (null: the file), rule (null: all): what noqa comments name."""
    rows = f.corpus.where(F.lower("source").contains("noqa")).select("path", F.posexplode(lines(F.col("source"))).alias("i", "text"))
    rows = rows.where(F.lower("text").contains("noqa")).withColumn("c", comment(F.col("text"))).where("c is not null")
    head = r"(?i)^(?:ruff:|flake8:)\s*(?=noqa)"
    whole = F.col("c").rlike(head)
    # `# ruff: noqa` for the file; anything else, as it stands, for the line
    rows = rows.withColumn("line", F.when(~whole, F.col("i") + 1)).withColumn("d", F.when(whole, F.regexp_replace("c", head, "")).otherwise(F.col("c")))
    rows = rows.where(F.col("d").rlike(r"(?i)^noqa($|\s|:)"))
    listed = F.regexp_extract("d", r"(?i)^noqa\s*:(.*)$", 1)
    codes = F.split(F.regexp_extract(listed, r"^((?:[, \t]*[A-Za-z][A-Za-z0-9]*(?=[, \t]|$))*)", 1), r"[, \t]+")
    bare = ~F.col("d").rlike(r"(?i)^noqa\s*:")
    known = F.filter(F.transform(codes, lambda c: lookup(CODES, c)), lambda r: r.isNotNull())
    named = rows.where(~bare).select("path", "line", F.explode(F.array_distinct(known)).alias("rule"))
    return named.unionByName(rows.where(bare).select("path", "line", F.lit(None).cast("string").alias("rule"))).distinct()


def suppress(issues: DataFrame, noqa: DataFrame) -> DataFrame:
    """Without the suppressed issues; parse errors stay."""
    s = noqa.select(F.col("path").alias("s_path"), F.col("line").alias("s_line"), F.col("rule").alias("s_rule"))
    on = (F.col("path") == F.col("s_path")) & (F.col("s_line").isNull() | (F.col("s_line") == F.col("line"))) & (F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule"))) & (F.col("rule") != "parse-error")
    return issues.join(s, on, "left_anti")


# --- fingerprints and baselines ----------------------------------------------------------------------------


def fingerprint() -> Column:
    """On wide issues: a key that lasts while lines move, where the rule allows."""
    rule, path = F.col("rule"), F.col("path")
    places = F.array_join(F.array_sort(F.transform("occurrences", lambda o: F.concat(o["path"], F.lit("#"), o["start_line"].cast("string"), F.lit("-"), o["end_line"].cast("string")))), "|")
    return (
        F.when(rule == "unused-import", F.concat_ws(":", rule, path, "line", "name"))
        .when(rule == "unused-dep", F.concat_ws(":", rule, "name", "source"))
        .when(rule == "duplicate", F.concat_ws(":", rule, F.col("token_count").cast("string"), places))
        .when(rule.isin("complexity", "refactor-target"), F.concat_ws(":", rule, path, "function"))
        .when(rule.isin(*SMELLS), F.concat_ws(":", F.lit("smell"), rule, path, "line"))
        .when(rule == "circular-dependency", F.concat_ws(":", rule, F.array_join(F.array_sort("cycle"), "|")))
        .when(rule == "feature-flag", F.concat_ws(":", rule, path, "line", "flag"))
        .otherwise(F.concat_ws(":", rule, path))
    )


def without_baseline(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """baseline: fingerprint."""
    return issues.withColumn("fingerprint", fingerprint()).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti").drop("fingerprint")


def baseline(issues: DataFrame) -> DataFrame:
    return issues.select(fingerprint().alias("fingerprint")).distinct().orderBy("fingerprint")


# --- score -------------------------------------------------------------------------------------------------


def weight() -> Column:
    """On wide issues: what one takes off the score."""
    rule = F.col("rule")
    over = lambda c, n: F.greatest(F.col(c) - n, F.lit(0)).cast("double")
    return (
        F.when(rule == "unused-file", 2.0)
        .when(rule == "unused-import", 0.1)
        .when(rule.isin("unused-dep", "duplicate"), 1.0)
        .when(rule == "complexity", 0.5 * over("cyclomatic", 10) + 0.3 * over("cognitive", 15))
        .when(rule == "low-maintainability", 2.0 + 0.05 * F.greatest(50 - F.col("mi_score"), F.lit(0)).cast("double"))
        .when(rule == "hotspot", F.least(F.greatest(F.col("hotspot_score") / 100, F.lit(0.5)), F.lit(5.0)))
        .when(rule == "money-as-float", 2.0)
        .when(rule.isin("mutable-default", "raise-from-none"), 1.5)
        .when(rule.isin("broad-except", "unreachable-after-exit"), 1.0)
        .when(rule.isin("single-method-class", "passthrough-function", "stray-print"), 0.5)
        .when(rule.isin("sentinel-equality", "truthy-length-check", "high-todo-density"), 0.3)
        .when(rule == "circular-dependency", F.least(F.greatest(F.size("cycle"), F.lit(2)), F.lit(10)).cast("double"))
        .when(rule == "parse-error", 5.0)
        .otherwise(0.0)
    )


def grade(value: Column) -> Column:
    return F.when(value >= 90, "A").when(value >= 80, "B").when(value >= 70, "C").when(value >= 60, "D").otherwise("F")


COUNTERS = {
    "unused_files": ["unused-file"], "unused_imports": ["unused-import"], "unused_deps": ["unused-dep"], "duplicates": ["duplicate"], "complexity": ["complexity"], "low_maintainability": ["low-maintainability"],
    "hotspots": ["hotspot"], "smells": SMELLS, "cycles": ["circular-dependency"], "refactor_targets": ["refactor-target"], "feature_flags": ["feature-flag"], "parse_errors": ["parse-error"],
}


def score(issues: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """value, grade, deduction and the counters; one row, or one for each group."""
    counts = [F.count_if(F.col("rule").isin(*rules)).alias(name) for name, rules in COUNTERS.items()]
    total = issues.groupBy(*by).agg(F.coalesce(F.sum(weight().cast("decimal(20,6)")), F.lit(0)).alias("deduction"), *counts)
    value = F.round(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("deduction")))).cast("int")  # in decimals, so that halves round as they should
    return total.select(*by, value.alias("value"), grade(value).alias("grade"), F.col("deduction").cast("double").alias("deduction"), *COUNTERS)


def trend(now: DataFrame, before: DataFrame) -> DataFrame:
    """metric, before, now, change: of two one-row scores; parse errors aren't compared; only what changed."""
    names = ["value", *(c for c in COUNTERS if c != "parse_errors")]

    def tall(df: DataFrame, alias: str) -> DataFrame:
        return df.select(*[F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "metric", alias)

    return tall(before, "before").join(tall(now, "now"), "metric").withColumn("change", F.col("now") - F.col("before")).where("change != 0")


# --- ownership ---------------------------------------------------------------------------------------------


def owner_regex(pattern: str) -> str:
    """A CODEOWNERS pattern as a regular expression of the whole path."""
    rooted = pattern.startswith("/")
    p = pattern.lstrip("/")
    if p.endswith("/"):
        return glob_regex(p + "**")
    if not any(c in p for c in "*?."):
        return glob_regex(f"**/{p}/**")
    return glob_regex(p if rooted else f"**/{p}")


def owned(rows: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """rows (path, ...) with owners: of the rules that match, the last one's; `(unowned)` without. The rules are a project's
    file, so they become one expression, with no join."""
    owner = F.lit("(unowned)")
    chain = None
    for pattern, names in reversed(rules):
        try:
            regex = owner_regex(pattern)
        except ValueError:
            continue
        hit = F.col("path").rlike(regex)
        chain = F.when(hit, " ".join(names)) if chain is None else chain.when(hit, " ".join(names))
    return rows.withColumn("owners", chain.otherwise(owner) if chain is not None else owner)


def ownership(issues: DataFrame, rules: list[tuple[str, list[str]]] | None) -> DataFrame:
    """owners, n: issues by owner; without rules by the first part of the path."""
    rows = owned(issues, rules) if rules is not None else issues.withColumn("owners", F.substring_index("path", "/", 1))
    return rows.groupBy("owners").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owners")


# --- scope -------------------------------------------------------------------------------------------------


def in_scope(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues of changed files; those of several files, where one of them changed. changed: path."""
    files = F.when(F.col("rule") == "duplicate", F.col("occurrences.path")).when(F.col("rule") == "circular-dependency", F.col("cycle")).otherwise(F.array("path"))
    keyed = stash(issues.withColumn("_id", F.xxhash64(fingerprint(), F.col("line"), F.col("detail"))), "issues")  # the analyses run once
    hit = keyed.select("_id", F.explode(files).alias("path")).join(changed.select("path").distinct(), "path", "left_semi").select("_id").distinct()
    return keyed.join(hit, "_id", "left_semi").drop("_id")


def verdict(count: int, most: int = 0) -> str:
    return "PASS" if count == 0 else "WARN" if count <= most else "FAIL"


# --- fixes -------------------------------------------------------------------------------------------------


def _lone_import(text: Column) -> Column:
    return F.trim(text).rlike(r"^(import|from)\s") & ~text.rlike(r"[,()\;]")


def fixable(f: Facts, unused: DataFrame) -> DataFrame:
    """path, line, fix: whether an unused import is alone on a line that can go whole."""
    text = f.corpus.select("path", F.posexplode(F.split("source", "\n", -1)).alias("i", "text")).withColumn("line", F.col("i") + 1)
    return unused.select("path", "line", "name").join(text, ["path", "line"]).select("path", "line", "name", _lone_import(F.col("text")).alias("fix"))


def fixed(f: Facts, unused: DataFrame) -> DataFrame:
    """path, source: the files that change, without the lines that fixable() allows to go. The lines are looked at inside the file's row."""
    spare = unused.groupBy("path").agg(F.collect_set("line").alias("spare"))
    text = F.split("source", "\n", -1)
    left = F.filter(text, lambda x, i: ~(F.array_contains("spare", i + 1) & _lone_import(x)))
    rows = f.corpus.join(spare, "path").select("path", F.size(text).alias("n"), left.alias("left"))
    return rows.where("size(left) < n").select("path", F.array_join("left", "\n").alias("source"))


# --- report rows -------------------------------------------------------------------------------------------


def cycle_text(cycle: Column) -> Column:
    """Members joined by arrows; of more than four the first two and the last."""
    short = F.concat(F.array_join(F.slice(cycle, 1, 2), " → "), F.format_string(" → … (%d total) → ", F.size(cycle)), F.element_at(cycle, -1))
    return F.when(F.size(cycle) > 4, short).otherwise(F.array_join(cycle, " → "))


def detail() -> Column:
    """On wide issues: what a report says of one."""
    rule = F.col("rule")
    return (
        F.when(rule == "unused-file", "no entry point reaches it")
        .when(rule == "unused-import", F.format_string("`%s` from `%s`", "name", "module"))
        .when(rule == "unused-dep", F.format_string("`%s` (declared in %s)", "name", "source"))
        .when(rule == "duplicate", F.format_string("%d tokens × %d places", F.col("token_count"), F.size("occurrences")))
        .when(rule == "complexity", F.format_string("`%s` cc=%d cog=%d", "function", "cyclomatic", "cognitive"))
        .when(rule == "refactor-target", F.format_string("`%s` cc=%d cog=%d effort=%s", "function", "cyclomatic", "cognitive", "effort"))
        .when(rule == "low-maintainability", F.format_string("MI=%d (average cc %.1f, %d lines)", "mi_score", "avg_cyclomatic", "loc"))
        .when(rule == "hotspot", F.format_string("cc=%d × churn=%d → %.1f", "cyclomatic", "churn", "hotspot_score"))
        .when(rule == "circular-dependency", cycle_text(F.col("cycle")))
        .when(rule == "feature-flag", F.format_string("`%s` by %s", "flag", "provider"))
        .when(rule == "parse-error", F.col("message"))
        .otherwise(F.col("detail"))
    )


def sarif_rows(issues: DataFrame) -> DataFrame:
    """issues with ruleIndex (in the sorted catalogue), level and message."""
    rules = issues.select("rule").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule")) - 1)
    return issues.join(F.broadcast(rules), "rule").withColumns({"level": level(F.col("rule")), "text": detail()})


def counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule")
