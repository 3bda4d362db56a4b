"""Fact tables of a corpus (path, source): parsed once on the executors, exploded in Catalyst."""

from __future__ import annotations

import gc
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcintel.functions.parse import parse

_shipped: set[str] = set()

IMPORTS = "array<struct<raw: string, kind: string, level: int, is_conditional: boolean, is_type_only: boolean>>"
BINDINGS = "array<struct<name: string, module: string, line: int, start: int, end: int, noqa: boolean>>"
REFS = "array<struct<name: string, offset: int>>"
FUNCTIONS = "array<struct<name: string, line: int, cyclomatic: int, cognitive: int>>"
SITES = "array<struct<role: string, scope: int, line: int, name: string, tail: string, text: string, n: int, flag: boolean, flag2: boolean, block: int, ord: int>>"
TOKENS = "array<struct<kind: string, text: string, line: int>>"

_S, _I, _B = pa.string(), pa.int32(), pa.bool_()


def _structs(**fields: pa.DataType) -> tuple[list[str], pa.DataType]:
    return list(fields), pa.list_(pa.struct(list(fields.items())))


_FLAT = {"is_script": _B, "has_getattr": _B}
_NESTED = {
    "imports": _structs(raw=_S, kind=_S, level=_I, is_conditional=_B, is_type_only=_B),
    "bindings": _structs(name=_S, module=_S, line=_I, start=_I, end=_I, noqa=_B),
    "refs": _structs(name=_S, offset=_I),
    "functions": _structs(name=_S, line=_I, cyclomatic=_I, cognitive=_I),
    "sites": _structs(role=_S, scope=_I, line=_I, name=_S, tail=_S, text=_S, n=_I, flag=_B, flag2=_B, block=_I, ord=_I),
    "tokens": _structs(kind=_S, text=_S, line=_I),
}


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, where it isn't on their path."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        at = Path(tempfile.mkdtemp(prefix="srcintel-code-")) / "srcintel_engine.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at))


def _nested(rows: list[list[tuple]], name: str) -> pa.Array:
    """A list<struct> column from tuples, built column by column."""
    fields, kind = _NESTED[name]
    off = [0]
    for r in rows:
        off.append(off[-1] + len(r))
    flat = [x for r in rows for x in r]
    cols = list(zip(*flat)) if flat else [()] * len(fields)
    inner = pa.StructArray.from_arrays([pa.array(c, kind.value_type.field(k).type) for k, c in enumerate(cols)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), inner)


#: What parse() can be asked for, besides the error.
PARTS = (*_FLAT, *_NESTED, "exports")
_KINDS = dict(zip(["is_script", "has_getattr", *_NESTED, "exports"], ["boolean", "boolean", IMPORTS, BINDINGS, REFS, FUNCTIONS, SITES, TOKENS, "array<string>"]))


#: Bytes of the tables that a corpus comes from, for a task that parses.
TASK = 1 << 20


def spread(corpus: DataFrame, by: str = "path", task: int = TASK) -> DataFrame:
    """corpus over all cores, in tasks that don't grow with it. A scan of enough tasks stays as it is; what comes out of exchanges may have been put
    together to few partitions by its size in bytes, a scan's tasks may hold as many row groups or none, and parsing costs far more than moving the text."""
    spark = corpus.sparkSession
    cores = spark.sparkContext.defaultParallelism
    run = corpus._jdf.queryExecution()
    leaves = run.optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length())]
    tasks = min(-(-sum(n for n in sizes if n < 1 << 50) // task), 10_000)  # what has no files has no size
    plan = run.executedPlan()
    if plan.nodeName() != "AdaptiveSparkPlan" and plan.execute().getNumPartitions() >= max(cores, tasks):
        return corpus
    return corpus.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), tasks), by)


def facts(corpus: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """path, source, error and the parts: a row for each file, with nested facts. corpus: path, source. Only what is asked for is computed."""
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"no such facts: {sorted(unknown)}")
    ship(corpus.sparkSession)
    parts = tuple(p for p in PARTS if p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(min(limit, 1000))
        gc.disable()  # syntax trees hold no cycles, and are many objects to look through
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):  # rows hold whole files
                    part = batch.slice(lo, 256)
                    found = [parse(s, parts) for s in part.column("source").to_pylist()]
                    columns = [pa.array([f["error"] for f in found], _S)]
                    for n in parts:
                        values = [f[n] for f in found]
                        columns.append(_nested(values, n) if n in _NESTED else pa.array(values, _FLAT.get(n, pa.list_(_S))))
                    yield pa.RecordBatch.from_arrays([part.column("path"), part.column("source"), *columns], ["path", "source", "error", *parts])
                gc.collect(0)
        finally:
            gc.enable()

    schema = ", ".join(["path string", "source string", "error string", *(f"{n} {_KINDS[n]}" for n in parts)])
    return spread(corpus.select("path", "source")).mapInArrow(run, schema)


class Facts:
    """The tables of one corpus. keep: one parse of `parts`, persisted (MEMORY_AND_DISK) until release(), for several analyses;
    what isn't kept is parsed by each table for itself, and only what it needs."""

    def __init__(self, corpus: DataFrame, keep: bool = True, parts: tuple[str, ...] = PARTS):
        self.corpus = corpus.select("path", "source")
        self.parts = parts
        self.kept = facts(corpus, parts).persist() if keep else None

    def release(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()

    def all(self, *parts: str) -> DataFrame:
        """path, source, error and at least these parts of each file."""
        return self.kept if self.kept is not None and set(parts) <= set(self.parts) else facts(self.corpus, parts)

    def modules(self, *parts: str) -> DataFrame:
        """The same of the files that could be parsed."""
        return self.all(*parts).where("error is null")

    def table(self, name: str) -> DataFrame:
        return self.modules(name).select("path", F.inline(name))

    @property
    def imports(self) -> DataFrame:
        return self.table("imports")

    @property
    def bindings(self) -> DataFrame:
        return self.table("bindings")

    @property
    def refs(self) -> DataFrame:
        return self.table("refs")

    @property
    def functions(self) -> DataFrame:
        return self.table("functions")

    def sites(self, *roles: str) -> DataFrame:
        """The sites with one of the roles; others are dropped inside the array, before it is exploded."""
        wanted = F.filter("sites", lambda s: s["role"].isin(*roles))
        return self.modules("sites").select("path", F.inline(wanted))

    @property
    def tokens(self) -> DataFrame:
        """path, pos, kind, text, line. Files with errors have tokens, too."""
        return self.all("tokens").select("path", F.posexplode("tokens").alias("pos", "t")).select("path", "pos", "t.kind", "t.text", "t.line")

    @property
    def parse_errors(self) -> DataFrame:
        return self.all().where("error is not null").select("path", F.col("error").alias("message"))


def imports_any(prefixes: list[str], absolute: bool = True) -> Column:
    """On modules: an import equals one of the prefixes or lies below it."""

    def hit(i: Column) -> Column:
        named = F.lit(False)
        for p in prefixes:
            named = named | (i["raw"] == p) | i["raw"].startswith(p + ".")
        return named & (i["kind"] == "absolute") if absolute else named

    return F.exists("imports", hit)
