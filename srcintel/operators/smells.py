"""Eleven anti-pattern rules and the feature-flag inventory, over one table of sites."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcintel.functions.names import is_pytest_entry
from srcintel.operators.facts import Facts, imports_any
from srcintel.operators.health import lines

MONEY = ("price", "amount", "cost", "fee", "subtotal", "revenue", "payment", "discount")
MARKERS = "TODO|FIXME|XXX|HACK"


def _issues(rows: DataFrame, rule: str, detail: Column | str, line: Column | str = "line") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "path", F.col(line).alias("line") if isinstance(line, str) else line.alias("line"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _product(rows: DataFrame) -> DataFrame:
    """Without test modules."""
    return rows.where(~is_pytest_entry(F.col("path")))


def mutable_default(f: Facts) -> DataFrame:
    literal = F.col("name").isin("List", "Dict", "Set")
    call = (F.col("name") == "Call") & F.col("tail").isin("list", "dict", "set")
    return _issues(f.sites("default").where(literal | call), "mutable-default", "mutable default argument is shared between calls; use None and create it inside")


def broad_except(f: Facts) -> DataFrame:
    rows = f.sites("handler").where(F.col("name").isin("", "Exception", "BaseException") & ~F.col("flag"))
    kind = F.when(F.col("name") == "", "bare except").otherwise("except Exception")
    return _issues(rows, "broad-except", F.concat(kind, F.lit(" hides errors; catch what can happen or raise again")))


def sentinel_equality(f: Facts) -> DataFrame:
    rows = f.sites("compare").where(F.col("name").isin("Eq", "NotEq") & ~F.col("flag"))
    hint = F.when(F.col("text") == "None", "test for None with `is` or `is not`").otherwise(F.concat(F.lit("test for "), F.lower("text"), F.lit(" by truth: `if x` or `if not x`")))
    return _issues(rows, "sentinel-equality", hint)


def truthy_length(f: Facts) -> DataFrame:
    rows = f.sites("call_compare").where((F.col("name") == "len") & F.col("tail").isin("Gt", "GtE", "Eq", "NotEq") & (F.col("text") == "0"))
    return _issues(_product(rows), "truthy-length-check", "test the container's truth, not its length against 0")


def unreachable(f: Facts) -> DataFrame:
    """The first statement after each block's first exit; a block that ends with a lone pass after the exit is fine."""
    block = Window.partitionBy("path", "block").orderBy("ord")
    rows = f.sites("stmt").where(~F.col("flag2")).withColumn("after_exit", F.lag("flag").over(block))
    first = rows.where("after_exit").withColumn("rank", F.row_number().over(block)).where("rank = 1")
    return _issues(first.where(~((F.col("name") == "Pass") & (F.col("ord") == F.col("n") - 1))), "unreachable-after-exit", "nothing reaches this statement: the one before leaves the block")


def passthrough(f: Facts) -> DataFrame:
    rows = f.sites("forward").where("n > 0 and tail = text")
    return _issues(_product(rows), "passthrough-function", F.format_string("`%s` only hands its arguments on", "name"))


def stray_print(f: Facts) -> DataFrame:
    """Not in test modules, nor in files that are scripts."""
    library = f.modules("sites", "is_script").where(~F.col("is_script")).select("path", F.inline(F.filter("sites", lambda s: (s["role"] == "call") & (s["name"] == "print"))))
    return _issues(_product(library), "stray-print", "print() in a library module; use logging")


def single_method_class(f: Facts) -> DataFrame:
    rows = f.sites("class").where("n = 1 and flag and not flag2")
    return _issues(_product(rows), "single-method-class", F.format_string("class `%s` has only `%s` and no state; a function would do", "name", "tail"))


def todo_density(f: Facts, threshold: int = 5) -> DataFrame:
    """Lines with a marker after their first #."""
    count = F.size(F.filter(lines(F.col("source")), lambda x: x.rlike(rf"^[^#]*#.*({MARKERS})")))
    rows = f.modules().select("path", count.alias("n")).where(F.col("n") >= threshold)
    return _issues(rows, "high-todo-density", F.format_string(f"%d TODO/FIXME markers (threshold {threshold})", "n"), F.lit(1))


def raise_from_none(f: Facts) -> DataFrame:
    return _issues(f.sites("raise_from_none"), "raise-from-none", "`from None` drops the exception's cause")


def money_as_float(f: Facts, more: Iterable[str] = ()) -> DataFrame:
    rows = f.sites("typed").where(F.col("flag") & F.substring_index("name", "_", -1).isin(*MONEY, *more))
    return _issues(rows, "money-as-float", F.format_string("%s `%s` is a float; use Decimal for money", "text", "name"))


RULES: dict[str, Callable[..., DataFrame]] = {
    "mutable-default": mutable_default,
    "broad-except": broad_except,
    "sentinel-equality": sentinel_equality,
    "truthy-length-check": truthy_length,
    "unreachable-after-exit": unreachable,
    "passthrough-function": passthrough,
    "stray-print": stray_print,
    "single-method-class": single_method_class,
    "high-todo-density": todo_density,
    "raise-from-none": raise_from_none,
    "money-as-float": money_as_float,
}


def issues(f: Facts, disabled: Iterable[str] = (), todo_threshold: int = 5, money_words: Iterable[str] = ()) -> DataFrame:
    found = None
    for name, rule in RULES.items():
        if name in disabled:
            continue
        more = {"threshold": todo_threshold} if name == "high-todo-density" else {"more": tuple(money_words)} if name == "money-as-float" else {}
        one = rule(f, **more)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else _issues(f.sites("class").where("false"), "", "")


GATE = ["os", "django", "django.conf", "ldclient", "launchdarkly", "statsig", "UnleashClient", "unleash", "growthbook"]
PROVIDERS = {"launchdarkly": ("variation", "variation_detail", "bool_variation"), "statsig": ("check_gate", "get_config", "get_experiment"), "unleash": ("is_enabled",), "growthbook": ("is_on", "feature_value")}


def flags(f: Facts) -> DataFrame:
    """Feature flags: path, line, flag, provider. Modules without an import of a flag source are skipped whole."""
    gated = f.modules("imports", "sites").where(imports_any(GATE, absolute=False))
    rows = gated.select("path", F.inline(F.filter("sites", lambda s: s["role"].isin("method", "subscript"))))
    method, name = F.col("role") == "method", F.col("name")
    provider = F.when(method & (name == "get") & (F.col("tail") == "environ") & F.col("text").rlike("^(FEATURE_|FF_|ENABLE_|DISABLE_)"), "env-var")
    for p, methods in PROVIDERS.items():
        provider = provider.when(method & name.isin(*methods), p)
    provider = provider.when(~method & (name == "FEATURES") & (F.col("tail") == "settings"), "django-settings")
    return rows.withColumn("provider", provider).where("provider is not null").select(F.lit("feature-flag").alias("rule"), "path", "line", F.col("text").alias("flag"), "provider")
