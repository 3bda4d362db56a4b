"""The dead-code query: unreachable files, unused imports and dependencies, cycles, parse errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcintel.functions.names import is_init
from srcintel.operators import graph, plugins
from srcintel.operators.facts import Facts

ISSUE = "rule string, path string, line int, name string, module string, source string, token_count int, occurrences array<struct<path: string, start_line: int, end_line: int>>, function string, cyclomatic int, cognitive int, mi_score int, avg_cyclomatic float, loc int, churn int, hotspot_score double, detail string, cycle array<string>, effort string, flag string, provider string, message string"
ISSUE_COLUMNS = [c.split()[0] for c in ISSUE.replace(", start_line: int, end_line: int", "").split(", ")]

IMPORT_NAMES = {
    "pyyaml": "yaml", "pillow": "PIL", "pillow-simd": "PIL", "beautifulsoup4": "bs4", "pyjwt": "jwt", "python-dateutil": "dateutil", "scikit-learn": "sklearn", "scikit-image": "skimage",
    "python-dotenv": "dotenv", "python-multipart": "multipart", "opencv-python": "cv2", "opencv-python-headless": "cv2", "msgpack-python": "msgpack", "google-cloud-storage": "google",
    "google-cloud-pubsub": "google", "google-cloud-firestore": "google", "google-genai": "google", "google-auth": "google", "protobuf": "google", "google-api-python-client": "googleapiclient",
    "pyserial": "serial", "memcached-python": "memcache", "python-socketio": "socketio", "python-engineio": "engineio", "ruamel.yaml": "ruamel",
}
NEVER_FLAGGED = set(
    "setuptools wheel pip build hatchling poetry uv pdm flit maturin tox uvicorn gunicorn hypercorn daphne granian python-multipart email-validator ujson orjson httptools uvloop watchfiles "
    "websockets httpx psycopg psycopg2 psycopg2-binary psycopg-binary asyncpg aiopg mysqlclient pymysql aiomysql asyncmy cx-oracle cx_oracle oracledb pyodbc pymssql aioodbc".split()
)


@dataclass
class Project:
    """What isn't in the sources: all small tables. Paths are relative to the project's root."""

    roots: list[str] = field(default_factory=lambda: ["."])
    entry_points: list[str] = field(default_factory=list)
    plugins: dict[str, bool] = field(default_factory=dict)
    dependencies: DataFrame | None = None  # owner_path, name, source
    scripts: DataFrame | None = None  # module, group
    names: list[str] = field(default_factory=list)  # [project] names


def wide(df: DataFrame) -> DataFrame:
    """Any issues as the one wide table."""
    empty = df.sparkSession.createDataFrame([], ISSUE)
    return empty.unionByName(df, allowMissingColumns=True).select(*ISSUE_COLUMNS)


def unused_imports(f: Facts) -> DataFrame:
    """Bindings without a reference; package files and lines with noqa are exempt. All inside a module's own row."""
    spare = F.array_except("bindings.name", "refs.name")  # an import statement has no references of its own
    # the array of one element holds the spare names, so that they're found once a row, not once a binding
    free = F.transform(F.array(spare), lambda names: F.filter("bindings", lambda b: ~b["noqa"] & F.array_contains(names, b["name"])))[0]
    rows = f.modules("bindings", "refs").where(~is_init(F.col("path"))).select("path", F.inline(free))
    return rows.select(F.lit("unused-import").alias("rule"), "path", "line", "name", "module")


def library_candidates(name: str) -> list[str]:
    lower = name.strip().lower()
    found = [lower.replace("-", "_").replace(".", "_"), lower, name.strip()]
    return [x for x in dict.fromkeys(found) if x]


def static_entries(f: Facts, mods: DataFrame, project: Project) -> DataFrame:
    """path, source_kind, label of the entries that aren't a plugin's."""
    spark = mods.sparkSession
    config = mods.where(F.col("path").isin(*project.entry_points) if project.entry_points else F.lit(False)).select("path", F.lit("config").alias("source_kind"), F.lit("config").alias("label"))
    lazy = f.modules("has_getattr").where("has_getattr").select("path", F.lit("module-getattr").alias("source_kind"), F.lit("module __getattr__").alias("label"))
    found = config.unionByName(lazy)
    if project.scripts is not None:
        named = project.scripts.join(graph.targets(mods), F.col("module") == F.col("dotted"))
        found = found.unionByName(named.select(F.col("target").alias("path"), F.lit("pyproject").alias("source_kind"), F.concat(F.lit("pyproject:"), "group").alias("label")))
    rows = [(n, k, c) for n in project.names for k, c in enumerate(library_candidates(n))]
    if rows:
        candidates = spark.createDataFrame(rows, "name string, rank int, dotted string")
        first = Window.partitionBy("name").orderBy("rank")
        best = graph.targets(mods).join(F.broadcast(candidates), "dotted").withColumn("r", F.row_number().over(first)).where("r = 1")
        found = found.unionByName(best.select(F.col("target").alias("path"), F.lit("library").alias("source_kind"), F.concat(F.lit("library:"), "name").alias("label")))
    return found


def entries(f: Facts, mods: DataFrame, project: Project) -> DataFrame:
    """path, source_kind, label: every source of an entry point."""
    found = plugins.entries(f, project.plugins).select("path", F.lit("plugin").alias("source_kind"), F.col("plugin").alias("label"))
    return static_entries(f, mods, project).unionByName(found)


def import_names(dist: Column) -> Column:
    """The top-level modules that a distribution may provide."""
    lower = F.lower(dist)
    known = F.create_map(*[F.lit(x) for pair in IMPORT_NAMES.items() for x in pair])[lower]
    return F.when(known.isNotNull(), F.array(known)).otherwise(F.array_distinct(F.array(F.replace(lower, F.lit("-"), F.lit("_")), lower)))


def owners(paths: DataFrame, owner_paths: DataFrame) -> DataFrame:
    """path, owner: of the owning directories that hold the path, the longest. Joins on the path's own prefixes, so it is an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = paths.select("path", F.explode(above).alias("owner"))
    return rows.join(owner_paths.select("owner").distinct(), "owner").groupBy("path").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def unused_dependencies(f: Facts, reached: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared distributions of which no reached file of the same owner imports anything (for type checkers doesn't count).
    declared: owner_path, name, source."""
    lower = F.lower("name")
    skip = lower.startswith("types-") | lower.endswith("-stubs") | lower.isin(*sorted(NEVER_FLAGGED))
    placed = declared.withColumn("owner", F.when(F.col("owner_path") == ".", "").otherwise(F.rtrim(F.col("owner_path"), F.lit("/"))))
    wanted = placed.where(~skip)  # a member that declares only such distributions owns its files all the same
    used = f.imports.where("kind = 'absolute' and not is_type_only").join(reached, "path", "left_semi").select("path", F.substring_index("raw", ".", 1).alias("top")).distinct()
    owned = owners(used.select("path").distinct(), placed.select("owner"))
    seen = used.join(owned, "path").select(F.col("owner").alias("at"), "top").distinct()
    tries = wanted.withColumn("tops", import_names(F.col("name")))
    # candidates are one or two: exploded, an equi-join on (owner, name)
    hit = tries.select("owner", "name", "source", F.explode("tops").alias("try")).join(seen, (F.col("owner") == F.col("at")) & (F.col("try") == F.col("top")), "left_semi")
    free = tries.join(hit.select("owner", "name", "source").distinct(), ["owner", "name", "source"], "left_anti")
    return free.select(F.lit("unused-dep").alias("rule"), F.when(F.col("owner") == "", "pyproject.toml").otherwise(F.concat("owner", F.lit("/pyproject.toml"))).alias("path"), "name", "source")


#: What the dead-code query needs of a parse.
CHECKED = ("is_script", "has_getattr", "imports", "bindings", "refs", "sites")


def circular(f: Facts, roots: list[str]) -> DataFrame:
    """The cycles alone: only imports are parsed, nothing else is built."""
    found = graph.cycles(graph.edges(graph.modules(f, roots)))
    return wide(found.select(F.lit("circular-dependency").alias("rule"), F.element_at("cycle", 1).alias("path"), "cycle"))


@dataclass
class Analysis:
    facts: Facts
    modules: DataFrame
    entries: DataFrame
    edges: DataFrame
    reached: DataFrame
    issues: DataFrame


def analyse(corpus: DataFrame, project: Project | None = None, facts: Facts | None = None) -> Analysis:
    """The whole query. The parse is shared; each part is its own plan."""
    project = project or Project()
    f = facts or Facts(corpus, parts=CHECKED)
    mods = graph.modules(f, project.roots)
    edge = graph.edges(mods)
    start = entries(f, mods, project)
    free, reached = graph.unreachable(mods, edge, start.select("path").distinct())
    found = [
        f.parse_errors.select(F.lit("parse-error").alias("rule"), "path", "message"),
        free.select(F.lit("unused-file").alias("rule"), "path"),
        unused_imports(f).join(reached, "path", "left_semi"),
        graph.cycles(edge).select(F.lit("circular-dependency").alias("rule"), F.element_at("cycle", 1).alias("path"), "cycle"),
    ]
    if project.dependencies is not None:
        found.append(unused_dependencies(f, reached, project.dependencies))
    all_ = wide(found[0])
    for one in found[1:]:
        all_ = all_.unionByName(wide(one))
    return Analysis(f, mods, start, edge, reached, all_)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy("path", F.coalesce("line", F.lit(0)), "rule", "name", "function", "flag")


def inventory(a: Analysis) -> DataFrame:
    """path and its entry sources, joined in order."""
    return a.entries.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("sources"))
