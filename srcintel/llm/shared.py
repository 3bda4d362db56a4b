"""The folder that all executors share, tables written there to cut lineage, code for the workers, and tables of any column names."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcintel.operators.facts import ship
from srcintel.storage import folder, mark, place, release, stash

__all__ = ["folder", "fresh", "keyed", "local_path", "mark", "named", "release", "row_key", "ship", "stash", "tasks"]


def local_path(at: str) -> str:
    """A place in the shared folder as a path which Python on every executor can open (a shared mount)."""
    if at.startswith("file:"):
        at = "/" + at[5:].lstrip("/")
    if "://" in at:
        raise ValueError(f"spark.checkpoint.dir must be a folder that all executors mount (file:), not {at}")
    return at


def fresh(spark: SparkSession, name: str) -> str:
    """A new subfolder for files that workers write and map; release() deletes it."""
    at = local_path(place(spark, name))
    os.makedirs(at, exist_ok=True)
    return at


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(plain: DataFrame) -> list[Column]:
    """128 bits that tell rows apart, over all columns; rows equal in all columns have the same. plain: of names that need no quotes."""

    def hashable(name: str, kind: str) -> Column:
        return F.to_json(F.struct(name)) if "map<" in kind or "variant" in kind else F.col(name)

    cols = [c for name, kind in plain.dtypes for c in (F.col(name).isNull(), hashable(name, kind))]
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(7), *cols).alias("_k2")]


def keyed(docs: DataFrame, **wanted: str) -> tuple[DataFrame, list[str]]:
    """(c0, c1, ... for the columns of docs, _k1, _k2 and the wanted ones; the columns' names). Whatever the table's columns are
    called, nothing clashes with the names that an operator uses. wanted: name=kind of columns of docs, cast to that kind."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    more = [F.col(f"c{names.index(name)}").cast(kind).alias(name) for name, kind in wanted.items()]
    return plain.select("*", *row_key(plain), *more), names


def named(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns of a table that keyed() made under their own names; instead: other values for some."""
    return df.select(*[instead.get(name, F.col(f"c{k}")).alias(name) for k, name in enumerate(names)])
