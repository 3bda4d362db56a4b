"""A Spark data source of Python files: path (relative) and source. Spark's own file sources drop names that begin with _ or a dot."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from srcintel.functions.names import glob_regex


def ignore_rules(text: str, folder: str = "") -> list[tuple[bool, bool, re.Pattern]]:
    """(negated, only directories, expression of the relative path) of a .gitignore file's lines."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        rooted = "/" in line
        body = "".join(("(?:.*/)?" if p == "**/" else ".*" if p in ("/**", "**") else "[^/]*" if p == "*" else "[^/]" if p == "?" else p if p.startswith("[") else re.escape(p)) for p in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|[^*?\[/]+|/|\[", line.lstrip("/")))
        prefix = re.escape(folder + "/") if folder else ""
        out.append((negated, only_dirs, re.compile("^" + prefix + ("" if rooted else "(?:.*/)?") + body + "$")))
    return out


def python_files(root: str, ignore: list[str] = (), roots: list[str] = (".",)) -> list[tuple[str, int, int]]:
    """(relative path, mtime in ns, size) of the .py files below the roots, hidden ones too, that neither .gitignore nor the globs exclude."""
    globs = []
    for g in ignore:
        try:
            globs.append(re.compile(glob_regex(g)))
        except (ValueError, re.error):
            continue
    found: dict[str, tuple[str, int, int]] = {}
    for start in roots:
        top = Path(root) / start
        rules: list = []
        for folder, dirs, files in os.walk(top):
            rel = os.path.relpath(folder, root)
            rel = "" if rel == "." else rel.replace(os.sep, "/")
            if ".gitignore" in files:
                rules = rules + ignore_rules(Path(folder, ".gitignore").read_text(errors="replace"), rel)

            def dropped(path: str, is_dir: bool) -> bool:
                out = False
                for negated, only_dirs, expression in rules:
                    if (is_dir or not only_dirs) and expression.match(path):
                        out = not negated
                return out

            join = (rel + "/").lstrip("/") if rel else ""
            dirs[:] = sorted(d for d in dirs if d != ".git" and not dropped(join + d, True) and not any(g.match(join + d + "/x") for g in globs))
            for name in sorted(files):
                path = join + name
                if name.endswith(".py") and not dropped(path, False) and not any(g.match(path) for g in globs):
                    stat = os.stat(os.path.join(folder, name))
                    found[path] = (path, stat.st_mtime_ns, stat.st_size)
    return list(found.values())


class _Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.ignore = [g for g in options.get("ignore", "").split("\n") if g]
        self.roots = [r for r in options.get("roots", ".").split("\n") if r]
        self.size = int(options.get("chunkbytes", str(4 << 20)))

    def partitions(self) -> list[InputPartition]:
        chunks, now, held = [], [], 0
        for path, _, size in python_files(self.root, self.ignore, self.roots):
            now.append(path)
            held += size
            if held >= self.size:
                chunks.append(_Chunk(now))
                now, held = [], 0
        return [*chunks, *([_Chunk(now)] if now else [])] or [_Chunk([])]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        kept = []
        for p in partition.paths:
            try:
                kept.append((p, Path(self.root, p).read_bytes().decode("utf-8", "replace")))
            except OSError:
                continue
        if kept:
            paths, sources = zip(*kept)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sources, pa.string())], ["path", "source"])


class _Changes(SimpleDataSourceStreamReader):
    """Paths that were made, changed or removed since the last poll; the offset holds each file's time and size."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.ignore = [g for g in options.get("ignore", "").split("\n") if g]

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _now(self) -> dict:
        return {p: [m, s] for p, m, s in python_files(self.root, self.ignore)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = start["files"], self._now()
        rows = [(p, "removed") for p in before if p not in now] + [(p, "created" if p not in before else "modified") for p, v in now.items() if before.get(p) != v]
        return iter(sorted(rows)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, now = start["files"], end["files"]
        rows = [(p, "removed") for p in before if p not in now] + [(p, "created" if p not in before else "modified") for p, v in now.items() if before.get(p) != v]
        return iter(sorted(rows))


class PythonSource(DataSource):
    """spark.read.format("pysource").load(root): path, source; as a stream: path, change."""

    @classmethod
    def name(cls) -> str:
        return "pysource"

    def schema(self) -> str:
        return "path string, change string" if self.options.get("stream") else "path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def read(spark: SparkSession, root: str, ignore: list[str] = (), roots: list[str] = (".",)) -> DataFrame:
    """(path, source) of a project; the executors read the files, in chunks of some MB."""
    from srcintel.operators.facts import ship

    ship(spark)
    spark.dataSource.register(PythonSource)
    return spark.read.format("pysource").option("ignore", "\n".join(ignore)).option("roots", "\n".join(roots)).load(os.path.abspath(root))
