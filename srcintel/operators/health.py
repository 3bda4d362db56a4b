"""Complexity, maintainability, refactoring targets and churn hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcintel.functions.names import is_test_adjacent
from srcintel.operators.facts import Facts


def lines(source: Column) -> Column:
    """A text's lines, without the empty one that a final line end leaves."""
    parts = F.split(source, r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def loc(source: Column) -> Column:
    """Lines that are neither blank nor a comment."""
    return F.size(F.filter(lines(source), lambda x: x.rlike(r"^\s*[^\s#]")))


def volume(tokens: Column) -> Column:
    """Halstead volume, N log2 n, at least 1: layout tokens don't count, all numbers are one operand, all strings another."""
    real = F.filter(tokens, lambda t: ~t["kind"].isin("newline", "indent", "dedent"))
    keys = F.transform(real, lambda t: F.when(t["kind"].isin("number", "string"), t["kind"]).otherwise(F.concat_ws(":", t["kind"], t["text"])))
    return F.greatest(F.lit(1.0), F.size(keys) * F.log2(F.greatest(F.size(F.array_distinct(keys)), F.lit(1)).cast("double")))


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    """0 to 100; null without lines."""
    raw = 171 - 5.2 * F.log(volume) - 0.23 * F.greatest(cyclomatic, F.lit(1.0)) - 16.2 * F.log(loc.cast("double"))
    return F.when(loc > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))).cast("int"))


def files(f: Facts) -> DataFrame:
    """path, total_cyclomatic, n_functions, avg_cyclomatic, loc, mi of each module: one row in, one row out."""
    total = F.aggregate("functions", F.lit(0), lambda a, x: a + x["cyclomatic"])
    n = F.size("functions")
    rows = f.modules("functions", "tokens").select("path", total.alias("total_cyclomatic"), n.alias("n_functions"), loc(F.col("source")).alias("loc"), volume(F.col("tokens")).alias("volume"))
    rows = rows.withColumn("avg_cyclomatic", F.when(F.col("n_functions") > 0, F.col("total_cyclomatic") / F.col("n_functions")).otherwise(1.0))
    return rows.withColumn("mi", maintainability(F.col("volume"), F.col("avg_cyclomatic"), F.col("loc")))


def complex_functions(functions: DataFrame, cyclomatic: int = 10, cognitive: int = 15, top: int | None = None) -> DataFrame:
    """Functions over either threshold; with `top`, the most complex instead."""
    if top is not None:
        found = functions.orderBy(F.desc(F.col("cyclomatic") + F.col("cognitive")), "path", "line").limit(top)
    else:
        found = functions.where((F.col("cyclomatic") > cyclomatic) | (F.col("cognitive") > cognitive))
    return found.select(F.lit("complexity").alias("rule"), "path", "line", F.col("name").alias("function"), "cyclomatic", "cognitive")


def low_maintainability(files: DataFrame, least: int = 30, min_loc: int = 50) -> DataFrame:
    found = files.where((F.col("loc") >= min_loc) & (F.col("mi") < least) & ~is_test_adjacent(F.col("path")))
    return found.select(F.lit("low-maintainability").alias("rule"), "path", F.col("mi").alias("mi_score"), F.col("avg_cyclomatic").cast("float").alias("avg_cyclomatic"), "loc")


def effort(cyclomatic: Column, cognitive: Column) -> Column:
    """low, medium or high; null for what needs no refactoring."""
    composite = cyclomatic + cognitive
    return F.when(composite < 10, None).when((cyclomatic <= 15) & (cognitive <= 20), "low").when((cyclomatic <= 25) & (cognitive <= 40), "medium").otherwise("high")


def refactor_targets(functions: DataFrame, only: str | None = None) -> DataFrame:
    found = functions.withColumn("effort", effort(F.col("cyclomatic"), F.col("cognitive"))).where("effort is not null")
    found = found.where(F.col("effort") == only) if only else found
    return found.select(F.lit("refactor-target").alias("rule"), "path", "line", F.col("name").alias("function"), "cyclomatic", "cognitive", "effort")


def churn(commits: DataFrame) -> DataFrame:
    """commits: a row for each path of each commit."""
    return commits.groupBy("path").agg(F.count("*").cast("int").alias("churn"))


def hotspots(files: DataFrame, churned: DataFrame, top: int = 10, least: int = 3) -> DataFrame:
    """The files with the highest complexity x ln(churn + 1)."""
    both = files.where("total_cyclomatic > 0").join(churned, "path", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    both = both.where(F.col("churn") >= max(least, 1)).withColumn("hotspot_score", F.col("total_cyclomatic") * F.log(F.col("churn") + 1.0))
    return both.orderBy(F.desc("hotspot_score"), "path").limit(top).select(F.lit("hotspot").alias("rule"), "path", F.col("total_cyclomatic").alias("cyclomatic"), "churn", "hotspot_score")


def issues(f: Facts, commits: DataFrame | None = None, cyclomatic: int = 10, cognitive: int = 15, maintainability: int = 30, hotspot_top: int = 10, top: int | None = None, targets: bool = False, effort: str | None = None) -> DataFrame:
    per_file = files(f)
    found = complex_functions(f.functions, cyclomatic, cognitive, top).unionByName(low_maintainability(per_file, maintainability), allowMissingColumns=True)
    if targets or effort:
        found = found.unionByName(refactor_targets(f.functions, effort), allowMissingColumns=True)
    if commits is not None:
        found = found.unionByName(hotspots(per_file, churn(commits), hotspot_top), allowMissingColumns=True)
    return found
