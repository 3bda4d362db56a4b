"""Framework entry points: a table of rules over sites, one pass for all plugins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcintel.functions.names import file_name, is_pytest_entry
from srcintel.functions.parse import DEEP, MAIN, PLAIN, WALK
from srcintel.operators.facts import Facts, imports_any

_ROUTES = "get post put patch delete head options"
#: (plugin, gate: imports of which one is needed, role, names, scope, condition on the site)
RULES: list[tuple[str, str, str, str, int, str]] = [
    ("fastapi", "fastapi starlette", "decorator", _ROUTES + " websocket", DEEP, "flag"),
    ("fastapi", "", "value", "FastAPI APIRouter", DEEP, "flag"),
    ("fastapi", "", "expr", "include_router", DEEP, "flag2"),
    ("fastmcp", "", "value", "FastMCP", DEEP, "flag"),
    ("fastmcp", "", "expr", "FastMCP", DEEP, "flag"),
    ("fastmcp", "fastmcp", "decorator", "tool resource prompt", DEEP, "flag"),
    ("prefect", "prefect", "decorator", "flow task materialize", DEEP, ""),
    ("click", "", "value", "Typer Group", DEEP, "flag"),
    ("click", "click typer", "decorator", "command group callback", DEEP, ""),
    ("pydantic", "pydantic pydantic_settings", "base", "BaseModel BaseSettings GenericModel RootModel", DEEP, ""),
    ("pydantic", "pydantic pydantic_settings", "decorator", "field_validator model_validator validator root_validator computed_field", DEEP, ""),
    ("sqlalchemy", "sqlalchemy sqlmodel flask_sqlalchemy", "base", "DeclarativeBase Base Model SQLModel MappedAsDataclass declarative_base", DEEP, ""),
    ("sqlalchemy", "sqlalchemy sqlmodel flask_sqlalchemy", "class_attr", "__tablename__", DEEP, ""),
    ("sqlalchemy", "sqlalchemy sqlmodel flask_sqlalchemy", "class_value", "mapped_column Column relationship", DEEP, ""),
    ("sqlalchemy", "sqlalchemy sqlmodel flask_sqlalchemy", "class_hint", "Mapped", DEEP, ""),
    ("django", "django rest_framework", "base", "Model AbstractUser AbstractBaseUser View APIView ViewSet GenericViewSet ModelViewSet ReadOnlyModelViewSet TemplateView ListView DetailView CreateView UpdateView DeleteView FormView RedirectView GenericAPIView ListAPIView RetrieveAPIView CreateAPIView DestroyAPIView UpdateAPIView BaseCommand AppCommand LabelCommand ModelAdmin TabularInline StackedInline Admin", MAIN, ""),
    ("django", "django rest_framework", "decorator", "receiver", MAIN, ""),
    ("celery", "celery", "value", "Celery", PLAIN, "flag"),
    ("celery", "celery", "expr", "Celery", PLAIN, "flag"),
    ("celery", "celery", "decorator", "task shared_task periodic_task", MAIN, ""),
    ("beanie", "beanie", "base", "Document View UnionDoc TimeSeriesConfig", MAIN, ""),
    ("beanie", "beanie", "decorator", "before_event after_event Insert Replace Save ValidateOnSave Delete", MAIN, ""),
    ("sqlmodel", "sqlmodel", "base", "SQLModel", WALK, ""),
    ("marshmallow", "marshmallow", "base", "Schema SchemaOpts", WALK, ""),
    ("marshmallow", "marshmallow", "decorator", "validates validates_schema pre_load post_load pre_dump post_dump", WALK, ""),
    ("starlette", "starlette", "value", "Starlette Route WebSocketRoute Mount Host", WALK, ""),
    ("starlette", "starlette", "expr", "Starlette Route WebSocketRoute Mount Host", WALK, ""),
    ("starlette", "starlette", "list_item", "Starlette Route WebSocketRoute Mount Host", WALK, ""),
    ("starlette", "starlette", "decorator", "exception_handler middleware on_event", WALK, ""),
    ("aiohttp", "aiohttp", "base", "View", WALK, ""),
    ("aiohttp", "aiohttp", "value", "Application RouteTableDef", WALK, "flag"),
    ("aiohttp", "aiohttp", "decorator", _ROUTES + " view route", WALK, ""),
    ("flask", "flask", "base", "View MethodView", WALK, ""),
    ("flask", "flask", "value", "Flask Blueprint", WALK, "flag"),
    ("flask", "flask", "decorator", "route get post put delete patch before_request before_first_request after_request teardown_request teardown_appcontext errorhandler context_processor url_value_preprocessor url_defaults command", WALK, ""),
]
PLUGINS = ("script", "pytest", "alembic", *dict.fromkeys(r[0] for r in RULES))
_SETTINGS = "INSTALLED_APPS MIDDLEWARE DATABASES ROOT_URLCONF AUTH_USER_MODEL WSGI_APPLICATION".split()


def _hit(site: Column, role: str, names: str, scope: int, condition: str) -> Column:
    out = (site["role"] == role) & site["tail"].isin(*names.split()) & (site["scope"].bitwiseAND(scope) != 0)
    return out & site[condition] if condition else out


def _any_site(role: str, names: str, scope: int, condition: str) -> Column:
    return F.exists("sites", lambda s: F.coalesce(_hit(s, role, names, scope, condition), F.lit(False)))


def _site(role: str, names: list[str]) -> Column:
    return F.exists("sites", lambda s: (s["role"] == role) & s["name"].isin(*names))


def _django(path: Column) -> Column:
    name = file_name(path)
    settings = (name == "settings.py") | name.startswith("settings_") | name.isin("asgi.py", "wsgi.py")
    imported = imports_any(["django", "rest_framework"])
    migration = path.rlike(r"(^|/)migrations(/|$)") & path.endswith(".py")
    return migration | (~imported & settings & _site("top_assign", _SETTINGS)) | (imported & ((name == "urls.py") | _site("top_assign", ["urlpatterns"])))


def _alembic(path: Column) -> Column:
    versions = path.rlike(r"(^|/)(alembic|[^/]*migrations)/versions/(.*/)?[^/]*\.py$")
    env = (file_name(path) == "env.py") & (path.rlike(r"(^|/)alembic/env\.py$") | F.col("beside_versions"))
    pair = imports_any(["alembic"]) & _site("top_def", ["upgrade"]) & _site("top_def", ["downgrade"])
    return versions | env | pair


def entries(f: Facts, enabled: dict[str, bool] | None = None) -> DataFrame:
    """Distinct (path, plugin): the modules that a plugin takes for entry points.

    The rules are evaluated on the nested row of each module, so the gate, the names and the path predicates
    take one pass and no shuffle; only env.py files look for a versions directory beside them."""
    on = [p for p in PLUGINS if (enabled or {}).get(p, True)]
    path = F.col("path")
    mods = f.modules("imports", "sites", "is_script")
    if "alembic" in on:
        folders = f.corpus.where(path.contains("versions/")).select(F.regexp_extract(path, r"^(.*/|)versions/", 1).alias("folder")).distinct()
        env = f.corpus.where(path.rlike(r"(^|/)env\.py$")).select("path", F.regexp_extract(path, r"^(.*/|)env\.py$", 1).alias("folder")).join(folders, "folder", "left_semi").select("path", F.lit(True).alias("beside"))
        mods = mods.join(env, "path", "left").withColumn("beside_versions", F.coalesce("beside", F.lit(False)))
    found: dict[str, list[Column]] = {p: [] for p in on}
    special = {"script": lambda: F.col("is_script") | (file_name(path) == "__main__.py"), "pytest": lambda: is_pytest_entry(path), "django": lambda: _django(path), "alembic": lambda: _alembic(path)}
    for p, make in special.items():
        if p in found:
            found[p].append(make())
    for plugin, gate, role, names, scope, condition in RULES:
        if plugin in found:
            hit = _any_site(role, names, scope, condition)
            found[plugin].append(imports_any(gate.split()) & hit if gate else hit)
    marks = [F.when(reduce(lambda a, b: a | b, conditions), F.lit(p)) for p, conditions in found.items()]
    return mods.select("path", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("plugin"))


