"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document d of source k with s_d words gets a rate w_d, 0 <= w_d <= `most`, so that the source's taken
words, sum s_d w_d, meet its target T_k while the rates stay as near to 1 as can be in relative entropy:
minimise sum (w log w - w + 1). The solution is the exponential tilt w_d = min(most, exp(l_k x_d)), x_d being
s_d over the source's mean; l_k solves the convex dual, by Newton steps on log(taken) kept inside a bracket.
A rate depends on the document only through its source and size, so the sums run over the exact histogram
(source, size) -> documents, which map-side aggregation makes: a hot source is pre-aggregated before any
shuffle. Each step is one aggregation by source; a round's state is written to the shared folder.

Rounding: down each source's sizes, systematic rounding of the running sum of the fractions (in integer
millionths), so a source's taken words differ from the sum of rates by about one document's size. A document's
place in its (source, size) group comes from counts per hash bucket and a rank inside the bucket: no window
holds more than a bucket, the buckets of a group, the sizes of a source, or a row for each task.

Nulls: a null source is a source (the last one); a null or blank text has size 0, is taken 0 times and has no
effect. Repeated rows are documents of their own. A table without words has targets 0. Reruns agree.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcintel.llm.shared import stash, tasks

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000


def sizes(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, source and number of words of each document."""
    n = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*ids, F.col("source").cast("string").alias("source"), n.alias("size"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with their number (from 0) in the order of source, nulls last. No window over all rows: each task numbers its own range of
    sources, and the ranges' sizes, a row for each task, are summed up."""
    n = tasks(rows.sparkSession)
    ordered = rows.withColumn("last", F.col("source").isNull()).repartitionByRange(n, "last", "source").sortWithinPartitions("last", "source").drop("last")
    own = stash(ordered.withColumn("id", F.monotonically_increasing_id()), "sources")
    split = own.withColumns({"range": F.shiftright("id", 33), "place": F.col("id").bitwiseAND((1 << 33) - 1)}).drop("id")
    sizes = split.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return split.join(F.broadcast(before), "range").withColumn("number", F.col("before") + F.col("place")).drop("range", "before", "place")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """source, source_size, docs, target: shares of the total by weight, each at most `most` x its source, the excess
    reshared by weight: min(most S, level w). The level is found as the contract tells it: all that are above their
    caps at a level stop there, the rest shares what is left, until none is above. A round is one sum over the sources; the capped ones only grow."""
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).cast("long").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = stash(numbered(by).withColumn("weight", weight).drop("number"), "weights")
    level, capped = 0.0, -1
    while True:
        over = level * F.col("weight") > most * F.col("source_size")
        row = s.agg(F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("stopped"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count_if(over).alias("n")).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (row["total"] - most * row["stopped"]) / row["weight"]  # whole numbers, so that reruns agree
    target = F.least(most * F.col("source_size"), F.lit(level) * F.col("weight")).cast("double")
    return s.select("source", "source_size", "docs", target.alias("target"))


def _rate(most: float) -> Column:
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(50.0)))))


def tilts(histogram: DataFrame, goal: DataFrame, most: float = 3, rounds: int = 200, close: float = 1e-7) -> DataFrame:
    """The goal table with each source's tilt, and `full` where every document must be taken `most` times. Rounds end when every source is
    within `close` of its target, or its bracket is as narrow as numbers allow; a warning tells if `rounds` weren't enough."""
    scale = F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))
    state = goal.withColumns({"scale": scale.cast("double"), "full": F.col("target") >= most * F.col("source_size") * (1 - 1e-9), "tilt": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "off": F.lit(float("inf"))})
    keep = ["source", "source_size", "docs", "target", "scale", "full"]
    for _ in range(rounds):
        joined = histogram.join(state, histogram["key"].eqNullSafe(state["source"])).withColumn("x", F.col("size") / F.col("scale"))
        rate = _rate(most)
        words = F.col("n") * F.col("size")
        got = F.sum(words * rate)
        slope = F.sum(F.when(rate < most, words * F.col("x") * rate).otherwise(0.0))
        new = joined.groupBy(*keep, "tilt", "low", "high").agg(got.alias("got"), slope.alias("slope"))
        miss = F.log(F.col("got") / F.col("target"))
        low, high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.coalesce(F.col("tilt") - miss * F.try_divide("got", "slope"), F.lit(float("nan")))
        new = new.withColumns({"off": F.when(F.col("full"), F.lit(0.0)).otherwise(F.abs(miss)), "low": low, "high": high, "newton": newton})
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) & ~F.isnan("newton")
        middle = F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1).when(F.col("high") == float("inf"), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        next_tilt = F.when(F.col("off") <= close, F.col("tilt")).when(inside, F.col("newton")).otherwise(middle)
        state = stash(new.select(*keep, next_tilt.alias("tilt"), "low", "high", "off"), "tilts")
        worst = state.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-15 * F.abs("tilt"), F.col("off")))).first()[0]
        if worst is None or worst <= close:
            return state
    warnings.warn(f"a source's taken words are still off their target by a factor of exp({worst:.2g})", stacklevel=2)
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, buckets: int = 1024, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, source, size, source_size, target, taken, copies (times it is taken), for every document."""
    spark = docs.sparkSession
    sized = stash(sizes(docs, ids), "sizes")
    goal = stash(targets(sized, weights, most), "targets")
    histogram = stash(sized.where("size > 0").groupBy(F.col("source").alias("key"), "size").agg(F.count("*").alias("n")), "histogram")
    state = tilts(histogram, goal, most).select("source", "source_size", "target", "scale", "full", "tilt")
    grouped = histogram.join(state, histogram["key"].eqNullSafe(state["source"])).withColumn("x", F.col("size") / F.col("scale"))
    micro = F.round(_rate(most) * UNIT).cast("long")
    grouped = grouped.withColumn("micro", micro).withColumns({"whole": F.expr(f"micro div {UNIT}"), "part": F.expr(f"micro % {UNIT}")})
    along = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    grouped = grouped.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("part")).over(along), F.lit(0)))
    rates = grouped.select("key", "size", "source_size", "target", "whole", "part", "before")
    # places inside (source, size)
    own = sized.where("size > 0").withColumn("hash", F.xxhash64(*ids)).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    counts = own.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    to_here = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(to_here), F.lit(0))).drop("in_bucket")
    rates = counts.join(rates, counts["source"].eqNullSafe(rates["key"]) & (counts["size"] == rates["size"])).select(counts["source"].alias("key"), counts["size"].alias("of"), F.col("bucket").alias("b"), "source_size", "target", "whole", "part", (F.col("before") + F.col("earlier") * F.col("part")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("hash", *ids))
    ranked = own.withColumn("rank", rank)
    placed = ranked.join(rates, ranked["source"].eqNullSafe(rates["key"]) & (ranked["size"] == rates["of"]) & (ranked["bucket"] == rates["b"]))
    half = UNIT // 2
    copies = F.expr(f"whole + ((base + rank * part + {half}) div {UNIT}) - ((base + (rank - 1) * part + {half}) div {UNIT})")
    some = placed.withColumn("copies", copies).select(*ids, "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    none = sized.where("size = 0")
    goal = goal.withColumnRenamed("source", "key")
    none = none.join(goal, none["source"].eqNullSafe(goal["key"])).select(*ids, "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return some.unionByName(none)
