"""Corpora of Python modules templated from tables, so that SQL can compute what the engine must find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each smell: (a source that has it, the line, a source like it that hasn't).
SMELLS: dict[str, tuple[str, int, str]] = {
    "mutable-default": ("def f(a, b=[]):\n    return b\n", 1, "def f(a, b=()):\n    return b\n"),
    "broad-except": ("try:\n    x = 1\nexcept Exception:\n    x = 2\n", 3, "try:\n    x = 1\nexcept Exception:\n    raise\n"),
    "sentinel-equality": ("x = 1\ny = x == None\n", 2, "x = 1\ny = User.name == None\n"),
    "truthy-length-check": ("x = []\nif len(x) > 0:\n    x = 1\n", 2, "x = []\nif len(x) > 1:\n    x = 1\n"),
    "unreachable-after-exit": ("def f():\n    return 1\n    x = 2\n", 3, "def f():\n    return 1\n    pass\n"),
    "passthrough-function": ("x = 1\n\ndef f(a, b):\n    return g(a, b)\n", 3, "def f(a, b):\n    return g(b, a)\n"),
    "stray-print": ("x = 1\nprint(x)\n", 2, "if __name__ == '__main__':\n    print(1)\n"),
    "single-method-class": ("class A:\n    def run(self):\n        return self\n", 1, "class A:\n    size = 1\n    def run(self):\n        return self\n"),
    "high-todo-density": ("x = 1  # TODO a\n# FIXME b\n# XXX c\n# HACK d\n# TODO e\n", 1, "x = 1  # TODO a\n# FIXME b\n# XXX c\n# HACK d\n"),
    "raise-from-none": ("try:\n    x = 1\nexcept KeyError:\n    raise ValueError() from None\n", 4, "try:\n    x = 1\nexcept KeyError as e:\n    raise ValueError() from e\n"),
    "money-as-float": ("class A:\n    unit_price: float | None = None\n    b = 1\n", 2, "class A:\n    total: float = 0\n    b = 1\n"),
}

#: For each plugin: (a module name, a source that it takes, one that it leaves).
PLUGINS: dict[str, tuple[str, str, str]] = {
    "script": ("a.py", "if __name__ == '__main__':\n    run()\n", "if name == '__main__':\n    run()\n"),
    "fastapi": ("a.py", "from fastapi import APIRouter\nr = APIRouter()\n", "@app.get('/x')\ndef f(): ...\n"),
    "fastmcp": ("a.py", "from fastmcp import FastMCP\n@mcp.tool\ndef f(): ...\n", "from fastmcp import FastMCP\n@tool\ndef f(): ...\n"),
    "prefect": ("a.py", "import prefect\n@prefect.flow(name='x')\ndef f(): ...\n", "@flow\ndef f(): ...\n"),
    "click": ("a.py", "import click\n@click.command()\ndef f(): ...\n", "@command()\ndef f(): ...\n"),
    "pydantic": ("a.py", "from pydantic import BaseModel\nclass A(BaseModel): ...\n", "class A(BaseModel): ...\n"),
    "sqlalchemy": ("a.py", "import sqlalchemy as sa\nclass A:\n    __tablename__ = 'a'\n", "class A:\n    __tablename__ = 'a'\n"),
    "django": ("a.py", "from django.db import models\nclass A(models.Model): ...\n", "class A(models.Model): ...\n"),
    "celery": ("a.py", "from celery import Celery\napp = Celery('x')\n", "app = Celery('x')\n"),
    "beanie": ("a.py", "from beanie import Document\nclass A(Document): ...\n", "class A(Document): ...\n"),
    "alembic": ("a.py", "import alembic\ndef upgrade(): ...\ndef downgrade(): ...\n", "import alembic\ndef upgrade(): ...\n"),
    "sqlmodel": ("a.py", "import sqlmodel\nfor x in y:\n    class A(B[SQLModel]): ...\n    class C(SQLModel): ...\n", "class A(SQLModel): ...\n"),
    "marshmallow": ("a.py", "from marshmallow import Schema\nclass A(Schema): ...\n", "class A(Schema): ...\n"),
    "starlette": ("a.py", "from starlette.routing import Route\nroutes = [Route('/')]\n", "routes = [Route('/')]\n"),
    "aiohttp": ("a.py", "from aiohttp import web\napp = web.Application()\n", "app = web.Application()\n"),
    "flask": ("a.py", "from flask import Flask\napp = Flask('x')\n", "app = Flask('x')\n"),
    "pytest": ("test_a.py", "x = 1\n", ""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(rows: DataFrame, pick: str, sources: list[tuple[str, str]]) -> DataFrame:
    """rows (key) -> corpus: module and source number `pick` of the list."""
    all_ = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in sources])
    one = F.element_at(all_, F.expr(pick).cast("int") + 1)
    return rows.select(F.concat(F.lit("k"), F.col("key").cast("string"), F.lit("/"), one["p"]).alias("path"), one["s"].alias("source"))


def import_lines(names: DataFrame, by: str) -> DataFrame:
    """(by, ord, text) rows joined to one source for each `by`."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return names.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("source"))


def unused_import_modules(spark: SparkSession, sf: str) -> DataFrame:
    """A module for each part: imports its suppliers, and uses those that had a line returned."""
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("used"))
    used = F.array_sort(F.collect_list(F.struct("l_suppkey", "used")))
    name = lambda x: F.concat(F.lit("m_"), x["l_suppkey"].cast("string"))
    imports = F.transform("all", lambda x: F.concat(F.lit("import "), name(x), F.lit("\n")))
    uses = F.transform(F.filter("all", lambda x: x["used"] == 1), lambda x: F.concat(name(x), F.lit(".run()\n")))
    rows = rows.groupBy("l_partkey").agg(used.alias("all"))
    return rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), F.array_join(F.concat(imports, uses), "").alias("source"))


def supply_modules(spark: SparkSession, sf: str, hints: bool = False) -> DataFrame:
    """Nations import their suppliers, suppliers the parts of which they sell a large line and name the others in strings, large parts import the
    part 7 k + 1 (modulo the number of parts). hints: a supplier imports the parts of which all lines are open for type checkers only."""
    n = table(spark, sf, "part").count()
    nations = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    nations = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("m"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey").isNotNull(), F.concat(F.lit("import s"), F.col("s_suppkey").cast("string"), F.lit("\n"))).otherwise("x = 1\n").alias("text"))
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("real"), F.max("l_quantity").alias("most"))
    line = F.concat(F.lit("import p"), F.col("l_partkey").cast("string"), F.lit("\n"))
    name = F.concat(F.lit("x = 'p"), F.col("l_partkey").cast("string"), F.lit("'\n"))
    text = F.when(F.col("most") < 49, name).when((F.col("real") == 0) & F.lit(hints), F.concat(F.lit("if TYPE_CHECKING:\n    "), line)).otherwise(line)
    suppliers = table(spark, sf, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("m"), F.col("l_partkey").alias("ord"), F.coalesce(text, F.lit("x = 1\n")).alias("text"))
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(F.concat(F.lit("p"), key.cast("string")).alias("m"), key.alias("ord"), F.when(F.col("p_size") > 40, F.concat(F.lit("import p"), ((key * 7 + 1) % n).cast("string"), F.lit("\n"))).otherwise("x = 1\n").alias("text"))
    return import_lines(nations.union(suppliers).union(parts), "m").select(F.concat("m", F.lit(".py")).alias("path"), "source")


def package_modules(spark: SparkSession, sf: str) -> DataFrame:
    """r<region>/n<nation>/s<supplier>.py, with package files; each supplier imports the base of its nation, region or of all, by its key modulo 3."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    place = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    s = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    dots = F.element_at(F.array(F.lit("."), F.lit(".."), F.lit("...")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    suppliers = s.select(F.concat(place, F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("from "), dots, F.lit(" import base\n")).alias("source"))
    folders = n.select(F.explode(F.array(F.concat(place, F.lit("/")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/")), F.lit(""))).alias("d")).distinct()
    own = folders.select(F.explode(F.array(*[F.struct(F.concat("d", F.lit(f)).alias("path"), F.lit("x = 1\n").alias("source")) for f in ("__init__.py", "base.py")])).alias("f")).select("f.*")
    return suppliers.union(own)


def order_functions(spark: SparkSession, sf: str, nested: bool) -> DataFrame:
    """A function for each order, with an if for each of its lines; a module for each 50 orders."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").cast("int").alias("n"))
    one = "repeat('    ', i) || 'if x > ' || i || ':\n'" if nested else "'    if x > ' || i || ':\n        y = ' || i || '\n'"
    body = f"array_join(transform(case when n > 0 then sequence(1, n) else array() end, i -> {one}), '')"
    tail = "repeat('    ', n + 1) || 'y = 1\n'" if nested else "'    return x\n'"
    return import_lines(rows.select(F.expr("o_orderkey div 50").alias("g"), F.col("o_orderkey").alias("ord"), F.expr(f"'def f' || o_orderkey || '(x):\n' || {body} || {tail}").alias("text")), "g").select(F.concat(F.lit("g"), F.col("g").cast("string"), F.lit(".py")).alias("path"), "source")
