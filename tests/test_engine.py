"""The engine over small corpora."""

import json
import random
import subprocess

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcintel.functions.names import glob_regex
from srcintel.operators import clones, deadcode, graph, health, plugins, post, smells
from srcintel.operators.facts import Facts
from srcintel.plans import commands, report
from srcintel.sources import config, corpus, pysource
from srcintel.sources import project as projects
from srcintel.storage import stash


def make(spark, **files):
    return spark.createDataFrame([(p.replace("__slash__", "/"), s) for p, s in files.items()], "path string, source string")


def of(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, source string")


APP = {
    "myapp/main.py": "from fastapi import FastAPI\nfrom myapp.routers import users\napp = FastAPI()\napp.include_router(users.router)\n",
    "myapp/routers/users.py": "from fastapi import APIRouter\nfrom myapp.services import get\nrouter = APIRouter()\n@router.get('/u')\ndef f():\n    return get()\n",
    "myapp/services.py": "def get():\n    return 1\n",
    "myapp/orphan.py": "def lonely():\n    return 1\n",
}


def rules(issues, *cols):
    return sorted(tuple(r) for r in issues.select("rule", *cols).collect())


def test_small_app(spark):
    a = deadcode.analyse(of(spark, APP))
    assert rules(a.issues, "path") == [("unused-file", "myapp/orphan.py")]
    assert {r["label"] for r in a.entries.collect()} == {"fastapi"}


def test_order_of_files_does_not_matter(spark):
    one = rules(deadcode.analyse(of(spark, APP)).issues, "path")
    rows = list(APP.items())
    random.Random(1).shuffle(rows)
    other = spark.createDataFrame(rows, "path string, source string").repartition(3)
    assert rules(deadcode.analyse(other).issues, "path") == one


def test_library_and_scripts(spark):
    files = {"pkg/__init__.py": "from .a import x\n", "pkg/a.py": "x = 1\n", "pkg/cli.py": "def run(): ...\n", "other.py": "y = 1\n"}
    scripts = spark.createDataFrame([("pkg.cli", "scripts")], "module string, group string")
    a = deadcode.analyse(of(spark, files), deadcode.Project(names=["PKG"], scripts=scripts))
    assert rules(a.issues, "path") == [("unused-file", "other.py")]


def test_dependencies_by_owner(spark):
    files = {"a/x.py": "import yaml\n", "b/y.py": "import requests\n", "b/z.py": "if TYPE_CHECKING:\n    import numpy\n"}
    declared = spark.createDataFrame([("a", "PyYAML", "d"), ("a", "requests", "d"), ("b", "requests", "d"), ("b", "numpy", "d"), ("b", "uvicorn", "d"), (".", "types-x", "d")], "owner_path string, name string, source string")
    c = of(spark, files)
    got = deadcode.unused_dependencies(Facts(c), c.select("path"), declared).select("path", "name").collect()
    assert sorted(map(tuple, got)) == [("a/pyproject.toml", "requests"), ("b/pyproject.toml", "numpy")]


def test_members_own_their_files_whatever_they_declare(spark):
    files = {"a.py": "import yaml\n", "pkg/b.py": "import requests\n"}
    declared = spark.createDataFrame([(".", "requests", "d"), (".", "pyyaml", "d"), ("pkg", "uvicorn", "d")], "owner_path string, name string, source string")
    c = of(spark, files)
    got = deadcode.unused_dependencies(Facts(c), c.select("path"), declared).select("path", "name").collect()
    assert sorted(map(tuple, got)) == [("pyproject.toml", "requests")]


def test_cycles_alone(spark):
    files = {"a.py": "import b\n", "b.py": "import a, c\n", "c.py": "", "d.py": "import d\n"}
    got = deadcode.circular(Facts(of(spark, files), keep=False), ["."]).select("rule", "path", "cycle").collect()
    assert [tuple(r) for r in got] == [("circular-dependency", "a.py", ["a.py", "b.py"])]


def test_parents_of_reached_files(spark):
    files = {"a/__init__.py": "import z\n", "a/b/__init__.py": "", "a/b/c.py": "", "z.py": ""}
    a = deadcode.analyse(of(spark, files), deadcode.Project(entry_points=["a/b/c.py"]))
    assert rules(a.issues, "path") == [("unused-file", "z.py")]


@pytest.mark.parametrize("local", [True, False])
def test_graphs_against_plain_python(spark, local, monkeypatch):
    if not local:
        monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    rnd = random.Random(3)
    for _ in range(2):
        n = 9
        pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(13)})
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a in reach:
                reach[a] |= {y for x, y in pairs if x in reach[a]}
        edge = spark.createDataFrame(pairs, "src long, dst long")
        start = spark.createDataFrame([(0,), (1,)], "path long")
        assert {r[0] for r in graph.reachable(edge, start).collect()} == reach[0] | reach[1]
        want = {(a, min(b for b in reach[a] if a in reach[b])) for a in range(n) if any(b != a and a in reach[b] for b in reach[a])}
        assert {tuple(r) for r in graph.components(edge).collect()} == want


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_components_of_random_graphs(pairs):
    adjacent = {}
    for a, b in pairs:
        adjacent.setdefault(a, []).append(b)
    reach = {a: {a} for a in range(8)}
    for _ in range(8):
        for a in reach:
            reach[a] |= {y for x, y in pairs if x in reach[a]}
    want = {frozenset(b for b in reach[a] if a in reach[b]) for a in range(8)}
    assert {frozenset(p) for p in graph._tarjan(adjacent)} == {p for p in want if len(p) > 1}


def test_long_ways_take_few_rounds(spark, monkeypatch):
    """A ring of 3,000 nodes and a way of 1,000 into it: rounds grow with the logarithm of their length."""
    pairs = [(k, (k + 1) % 3000) for k in range(3000)] + [(k, k + 1) for k in range(5000, 6000)] + [(6000, 7)]
    edge = spark.createDataFrame(pairs, "src long, dst long")
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    tables = []
    monkeypatch.setattr(graph, "stash", lambda df, name="table": tables.append(name) or stash(df, name))
    got = graph.components(edge).collect()
    assert sorted(got) == [(k, 0) for k in range(3000)] and len(tables) < 40


@pytest.mark.parametrize("seed", range(4))
def test_contracted_components(spark, monkeypatch, seed):
    """Random graphs of few and many edges out, with ways between: the same components as in one task."""
    rng = random.Random(seed)
    n = 60
    pairs = {(a, rng.randrange(n)) for a in range(n) if rng.random() < 0.9} | {(rng.randrange(n), rng.randrange(n)) for _ in range((0, 10, 30, 90)[seed])}
    pairs |= {(100 + a, 100 + a + 1) for a in range(0, 20)} | {(120, rng.randrange(n)), (rng.randrange(n), 100 + rng.randrange(20))}
    edge = spark.createDataFrame(sorted(pairs), "src long, dst long")
    want = sorted(graph.components(edge).collect())
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    assert sorted(graph.components(edge).collect()) == want


def test_every_smell(spark):
    files = {f"{k}/{kind}.py": s[0] if kind == "bad" else s[2] for k, s in corpus.SMELLS.items() for kind in ("bad", "good")}
    got = rules(smells.issues(Facts(of(spark, files))), "path", "line")
    assert got == sorted((k, f"{k}/bad.py", s[1]) for k, s in corpus.SMELLS.items())


def test_smell_exemptions(spark):
    files = {"test_a.py": "print(1)\nif len(x) == 0: ...\nclass A:\n    def f(self): ...\n", "b.py": "def f():\n    raise X\n    yield\ntry: ...\nexcept* Exception: ...\nx = a.b == None\ny = A.b != None\n"}
    assert rules(smells.issues(Facts(of(spark, files))), "line") == [("sentinel-equality", 6)]
    assert smells.issues(Facts(of(spark, files)), disabled=list(smells.RULES)).count() == 0


def test_every_plugin(spark):
    files = {f"{k}/{p[0]}" if kind else f"no_{k}/a.py": p[1] if kind else p[2] for k, p in corpus.PLUGINS.items() for kind in (True, False)}
    got = {tuple(r) for r in plugins.entries(Facts(of(spark, files))).collect()}
    assert got == {(f"{k}/{p[0]}", k) for k, p in corpus.PLUGINS.items()}


def test_path_plugins(spark):
    files = {"app/migrations/0001.py": "", "alembic/versions/x/a.py": "", "db/env.py": "", "db/versions/b.py": "", "conf/settings.py": "DATABASES = {}\n", "conf/urls.py": "import django\n", "conftest.py": "", "a_test.py": "", "_test.py": "", "test_.py": "", "p/__main__.py": ""}
    got = {tuple(r) for r in plugins.entries(Facts(of(spark, files))).collect()}
    assert got == {("app/migrations/0001.py", "django"), ("alembic/versions/x/a.py", "alembic"), ("db/env.py", "alembic"), ("conf/settings.py", "django"), ("conf/urls.py", "django"), ("conftest.py", "pytest"), ("a_test.py", "pytest"), ("p/__main__.py", "script")}
    assert plugins.entries(Facts(of(spark, files)), dict.fromkeys(plugins.PLUGINS, False)).count() == 0


def brute_pairs(seqs, w, m):
    first = {}
    for path, keys in seqs.items():
        for i in range(len(keys) - w + 1):
            win = tuple(keys[i : i + w])
            if len(set(win)) >= m:
                first.setdefault(win, {}).setdefault(path, i)
    out = {}
    for places in first.values():
        for a in places:
            for b in places:
                if a < b:
                    new = (places[a], places[b])
                    out[a, b] = min(out.get((a, b), new), new)
    return {(a, b, *s) for (a, b), s in out.items()}


def test_clones_against_brute_force(spark):
    rnd = random.Random(5)
    seqs = {f"f{k}": [rnd.choice("abcd") for _ in range(rnd.randrange(40))] for k in range(8)}
    df = spark.createDataFrame([(p, k, list(range(len(k)))) for p, k in seqs.items()], "path string, keys array<string>, lines array<int>")
    got = {(r["path_a"], r["path_b"], r["start_a"], r["start_b"]) for r in clones.pairs(df, 5, 3).collect()}
    assert got == brute_pairs(seqs, 5, 3)
    with pytest.raises(ValueError):
        clones.pairs(df, 0)


def test_windows_of_many_places_are_split(spark, monkeypatch):
    monkeypatch.setattr(clones, "PLACES", 3)
    seqs = {f"f{k}": list("xabcdefg" if k % 2 else "yabcdefgz") for k in range(11)}
    df = spark.createDataFrame([(p, k, list(range(len(k)))) for p, k in seqs.items()], "path string, keys array<string>, lines array<int>")
    got = {(r["path_a"], r["path_b"], r["start_a"], r["start_b"]) for r in clones.pairs(df, 5, 3).collect()}
    assert got == brute_pairs(seqs, 5, 3) and len(got) == 55
    # a passage is the places of its first windows
    assert clones.members(df, 5, 3).groupBy("h1").count().count() < 5


def test_trace(spark):
    df = spark.createDataFrame([("a", list("vabcdefw"), list(range(8))), ("b", list("abcdef"), list(range(6))), ("c", list("pqabcdef"), list(range(8)))], "path string, keys array<string>, lines array<int>")
    issue = clones.issues(clones.pairs(df, 5, 3))
    assert issue.count() == 3
    assert {tuple(o["path"] for o in r["occurrences"]) for r in clones.trace(issue, "b", 2).collect()} == {("a", "b"), ("b", "c")}
    places = spark.createDataFrame([("b", 2), ("c", 1), ("a", 99)], "path string, line int")
    assert {tuple(o["path"] for o in r["occurrences"]) for r in clones.trace_all(issue, places).collect()} == {("a", "b"), ("b", "c")}


def test_clone_modes(spark):
    body = "def f(a):\n    x = a + {}\n    y = x * 'k'\n    return g(x, y, {})\n"
    files = {"a.py": body.format(1, 2), "b.py": body.format(3, 4), "c.py": body.format(1, 2).replace("a", "q"), "tests/t.py": body.format(1, 2)}
    f = Facts(of(spark, files))

    def found(mode, **more):
        return {(r["path_a"], r["path_b"]) for r in clones.pairs(clones.sequences(f, mode, **more), 25, 4).collect()}

    assert found("mild") == found("strict") == set()
    assert found("weak") == {("a.py", "b.py")}
    assert found("semantic") == {("a.py", "b.py"), ("a.py", "c.py"), ("b.py", "c.py")}
    assert ("a.py", "tests/t.py") in found("mild", skip_tests=False)


def test_health(spark):
    f = Facts(of(spark, {"a.py": "# head\n\ndef f():\n    pass\n    # end\n", "b.py": ""}))
    got = {r["path"]: r for r in health.files(f).collect()}
    assert got["a.py"]["loc"] == 2 and got["b.py"]["mi"] is None
    tall = spark.createDataFrame([("a", 1, "f", 1, 1), ("a", 2, "g", 9, 9), ("a", 3, "h", 20, 2)], "path string, line int, name string, cyclomatic int, cognitive int")
    assert [r["function"] for r in health.complex_functions(tall, top=2).collect()] == ["h", "g"]
    assert [r["function"] for r in health.complex_functions(tall).collect()] == ["h"]
    assert {(r["function"], r["effort"]) for r in health.refactor_targets(tall).collect()} == {("g", "low"), ("h", "medium")}


def test_noqa(spark):
    source = "x = 1  # noqa\ny = 2  # NOQA: E711, E712\nz = '# noqa'\nw = 3  # noqa: E711 - as it must be T201\nv = 4  # noqa: PLW1234\nu = 5  # noqaX\nt = 'it''s'  # noqa:F401\ns = 'a\\'#'  # noqa : B006\n"
    got = {(r["line"], r["rule"]) for r in post.suppressions(Facts(of(spark, {"a.py": source, "b.py": "# ruff: noqa: T201\n", "c.py": "#flake8:noqa\ndef\n"}))).where("path = 'a.py'").collect()}
    assert got == {(1, None), (2, "sentinel-equality"), (4, "sentinel-equality"), (7, "unused-import"), (8, "mutable-default")}
    f = Facts(of(spark, {"b.py": "# ruff: noqa: T201\n", "c.py": "# flake8: noqa\ndef\n"}))
    assert {tuple(r) for r in post.suppressions(f).collect()} == {("b.py", None, "stray-print"), ("c.py", None, None)}
    issues = deadcode.wide(spark.createDataFrame([("parse-error", "c.py", None), ("unused-file", "c.py", None), ("stray-print", "b.py", 3), ("unused-file", "b.py", None)], "rule string, path string, line int"))
    assert rules(post.suppress(issues, post.suppressions(f)), "path") == [("parse-error", "c.py"), ("unused-file", "b.py")]


def wide(spark, rows, schema):
    return deadcode.wide(spark.createDataFrame(rows, schema))


def test_fingerprints_and_score(spark):
    i = wide(spark, [("unused-import", "a.py", 3, "os")], "rule string, path string, line int, name string")
    d = wide(spark, [("duplicate", 50, [("b.py", 1, 2), ("a.py", 3, 4)])], "rule string, token_count int, occurrences array<struct<path: string, start_line: int, end_line: int>>")
    assert [r[0] for r in i.unionByName(d).select(post.fingerprint()).collect()] == ["unused-import:a.py:3:os", "duplicate:50:a.py#3-4|b.py#1-2"]
    thirty = wide(spark, [("unused-file", f"{k}.py") for k in range(30)], "rule string, path string")
    r = post.score(thirty).first()
    assert (r["value"], r["grade"], r["unused_files"]) == (40, "F", 30)
    tall = wide(spark, [("complexity", "a.py", 50, 80)], "rule string, path string, cyclomatic int, cognitive int")
    assert post.score(tall).first()["grade"] == "D" or post.score(tall).first()["value"] == 61
    assert post.score(thirty.limit(0)).first()["value"] == 100
    assert post.without_baseline(thirty, post.baseline(thirty)).count() == 0


def test_owners(spark):
    df = spark.createDataFrame([("src/auth/a.py",), ("auth/b.py",), ("x.py",)], "path string")
    got = {r["path"]: r["owners"] for r in post.owned(df, [("*", ["@all"]), ("src/auth/", ["@sec", "@x"])]).collect()}
    assert got == {"src/auth/a.py": "@sec @x", "auth/b.py": "@all", "x.py": "@all"}
    assert {r["owners"] for r in post.owned(df, [("nothing.py", ["@n"])]).collect()} == {"(unowned)"}
    assert glob_regex("**/a/*.py") == r"^(?:.*/)?a/.*\.py$"


def test_scope(spark):
    rows = wide(spark, [("circular-dependency", "a.py", ["a.py", "b.py"]), ("unused-file", "c.py", None)], "rule string, path string, cycle array<string>")
    assert rules(post.in_scope(rows, spark.createDataFrame([("b.py",)], "path string")), "path") == [("circular-dependency", "a.py")]
    assert [post.verdict(*x) for x in ((0, 0), (1, 2), (3, 2))] == ["PASS", "WARN", "FAIL"]


def test_fix(spark):
    f = Facts(of(spark, {"a.py": "import os\nimport re, sys\nx = 1\n"}))
    unused = deadcode.unused_imports(f)
    assert sorted((r["line"], r["fix"]) for r in post.fixable(f, unused).collect()) == [(1, True), (2, False), (2, False)]
    assert post.fixed(f, unused).first()["source"] == "import re, sys\nx = 1\n"


def test_reports(spark):
    rows = wide(spark, [("unused-file", "b.py", None, None, None), ("stray-print", "a.py", 2, "m", None), ("circular-dependency", "a.py", None, None, ["a.py", "b.py", "c.py", "d.py", "e.py"])], "rule string, path string, line int, detail string, cycle array<string>")
    sarif = json.loads(report.as_sarif(rows))["runs"][0]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["circular-dependency", "stray-print", "unused-file"]
    assert all(sarif["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in sarif["results"])
    cycle = next(r for r in sarif["results"] if r["ruleId"] == "circular-dependency")
    assert len(cycle["relatedLocations"]) == 4 and cycle["message"]["text"] == "a.py → b.py → … (5 total) → e.py"
    body = json.loads(report.as_json(rows, {"files_scanned": 2}))
    assert {"type": "smell", "path": "a.py", "line": 2, "rule": "stray-print", "detail": "m"} in body["issues"]
    assert "| **Total** | **3** |" in report.as_markdown(rows, {}) and "ok" in report.as_human(rows.limit(0), {})
    with pytest.raises(ValueError):
        report.render(rows, "xml", {})


@pytest.fixture
def tree(tmp_path):
    for p, s in {"src/app/__init__.py": "", "src/app/main.py": "import os\nfrom app import used\nif __name__ == '__main__':\n    used.x\n", "src/app/used.py": "x = 1\n", "src/app/_orphan.py": "y = 1\n", "src/gen/skip.py": "", "src/.hidden/h.py": "if __name__ == '__main__': ...\n", "src/build/b.py": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(s)
    (tmp_path / ".gitignore").write_text("gen/\n")
    (tmp_path / "src/.gitignore").write_text("gen/\n")
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "app-x"\ndependencies = ["requests>=2", "uvicorn"]\n')
    (tmp_path / "CODEOWNERS").write_text("# c\n*.py @py\n")
    return tmp_path


def test_source_reads_hidden_names(spark, tree):
    got = sorted(r["path"] for r in pysource.read(spark, str(tree), config.IGNORED, ["src"]).collect())
    assert got == ["src/.hidden/h.py", "src/app/__init__.py", "src/app/_orphan.py", "src/app/main.py", "src/app/used.py"]


def test_commands(spark, tree, capsys):
    (tree / "src/app/used.py").write_text("x = 1\nprint(x)\n")
    base = str(tree / "base.json")
    assert commands.main(["smells", str(tree), "--format", "json", "--score", "--save-baseline", base], spark) == 1
    out = capsys.readouterr()
    assert [(i["type"], i["rule"], i["line"]) for i in json.loads(out.out)["issues"]] == [("smell", "stray-print", 2)] and "score" in out.err
    assert json.loads((tree / "base.json").read_text())["fingerprints"] == ["smell:stray-print:src/app/used.py:2"]
    assert commands.main(["init", str(tree)]) == 0
    with pytest.raises(FileExistsError):
        commands.main(["init", str(tree)])
    for extra in (["llm"], ["config", str(tree)], ["ci-template", "github"]):
        assert commands.main(extra) == 0


def test_audit_and_git(spark, tree):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    run("add", "-A")
    run("commit", "-m", "1")
    run("checkout", "-b", "x")
    (tree / "src/app/used.py").write_text("def f(a=[]): ...\n")
    run("commit", "-am", "2")
    assert sorted(r["churn"] for r in health.churn(projects.commits(spark, tree)).collect())[-1] == 2
    w = commands.Workspace(spark, tree)
    assert rules(post.in_scope(w.smells(), projects.changed(spark, tree, "main")), "path") == [("mutable-default", "src/app/used.py")]
    with pytest.raises(RuntimeError):
        projects.changed(spark, tree, "nope")


def test_config_and_roots(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.srcintel]\npackageRoots = ["lib"]\nignorePatterns = ["x/**"]\n[tool.srcintel.plugins.flask]\n[tool.srcintel.smells]\ntodoThreshold = 3\n')
    c = config.load(tmp_path)
    assert c.package_roots == ["lib"] and c.plugins["flask"] is False and c.plugins["django"] and c.todo_threshold == 3 and c.ignore_patterns[-1] == "x/**"
    (tmp_path / "srcintel.toml").write_text('entryPoints = ["a.py"]\n')
    (tmp_path / ".srcintelignore").write_text("# c\ny/**\n")
    c = config.load(tmp_path)
    assert c.package_roots == [] and c.entry_points == ["a.py"] and c.ignore_patterns[-1] == "y/**"
    bare = config.Config()
    for m in ("a", "b"):
        (tmp_path / m / "app").mkdir(parents=True)
        (tmp_path / m / "app/__init__.py").write_text("")
        (tmp_path / m / "pyproject.toml").write_text("[project]\nname='x'\n")
    (tmp_path / "pyproject.toml").write_text("")
    with pytest.raises(ValueError, match="app"):
        projects.package_roots(tmp_path, bare)


def test_migrate(tmp_path):
    (tmp_path / "v.toml").write_text('[tool.vulture]\nexclude = ["a/"]\npaths = ["src", "run.py"]\n')
    assert 'entryPoints = ["run.py"]' in commands.migrate("vulture", str(tmp_path / "v.toml"))
    (tmp_path / ".importlinter").write_text("[importlinter]\nroot_package = app\n")
    assert "app" in commands.migrate("import-linter", str(tmp_path / ".importlinter"))


def test_watch(spark, tree):
    from srcintel.streaming import watch

    seen = []
    q = watch.rerun(watch.changes(spark, str(tree), config.IGNORED), lambda df: seen.extend(tuple(r) for r in df.collect()))
    try:
        q.processAllAvailable()
        (tree / "src/app/used.py").write_text("x = 22\n")
        (tree / "src/app/_orphan.py").unlink()
        q.processAllAvailable()
    finally:
        q.stop()
    assert ("src/app/main.py", "created") in seen and ("src/app/used.py", "modified") in seen and ("src/app/_orphan.py", "removed") in seen


def test_plans(spark):
    f = Facts(of(spark, APP), keep=False)
    plan = deadcode.unused_imports(f)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    pair = clones.pairs(clones.sequences(f))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in pair and "Window" not in pair
    assert f.imports.where(F.col("raw") == "os").count() == 0


def test_audit_of_large_nations(spark, tmp_path):
    """A nation of hundreds of suppliers: the rules of audit_whole's SQL, also where the file has grown past what health lets pass."""
    from srcintel import queries

    nation = spark.createDataFrame([(0, 0), (4, 0)], "n_nationkey long, n_regionkey long")
    supplier = spark.createDataFrame([(k, 4, 1.0) for k in range(1, 601)], "s_suppkey long, s_nationkey long, s_acctbal double")
    nation.write.parquet(f"{tmp_path}/nation.parquet")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    import duckdb

    for name in ("nation", "supplier"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = duckdb.sql(queries.ORACLES["audit_whole"]).fetchall()
    assert sorted(map(repr, map(tuple, queries.QUERIES["audit_whole"](spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_equal_files_are_paired_once(spark, monkeypatch):
    """Thirty copies of a file, five of one that shares a passage with it the other way round in length, some with other lines: all pairs as brute
    force finds them, of few rows."""
    text = [f"t{k}" for k in range(20)]
    other = ["x", "y", *text[3:15], "z", *text[:9]]
    rows = [(f"f{k:02d}", text, list(range(1, 21))) for k in range(30)] + [(f"{'ag'[k % 2]}{k}", other, list(range(1, len(other) + 1))) for k in range(5)]
    rows += [("e1", text, [1 + i // 3 for i in range(20)]), ("h1", [f"u{k}" for k in range(20)], list(range(1, 21)))]
    random.Random(2).shuffle(rows)

    def places(keys, lines):
        found = {}
        for i in range(len(keys) - 4):
            if len(set(keys[i : i + 5])) >= 3:
                found.setdefault(tuple(keys[i : i + 5]), (lines[i], lines[i + 4]))
        return found

    of = {p: places(k, n) for p, k, n in rows}
    want = set()
    for a in of:
        for b in of:
            if a < b and (both := [(of[a][w][0], of[b][w][0], of[a][w][1], of[b][w][1]) for w in of[a] if w in of[b]]):
                want.add((a, b, *min(both)))
    monkeypatch.setattr(clones, "CHUNK", 4)
    tables = {}
    monkeypatch.setattr(clones, "stash", lambda df, name="table": tables.setdefault(name, stash(df, name)))
    found = clones.pairs(spark.createDataFrame(rows, "path string, keys array<string>, lines array<int>"), 5, 3).collect()
    got = [(r["path_a"], r["path_b"], r["start_a"], r["start_b"], r["end_a"], r["end_b"]) for r in found]
    assert sorted(got) == sorted(want)
    assert tables["pairs"].count() == 5  # two kinds of copies with themselves, and three kinds with one another


def test_only_windows_that_may_be_shared_are_exchanged(spark, monkeypatch):
    rows = [(p, [f"{p}{k}" for k in range(400)] + [f"s{k}" for k in range(12)] + [f"{p}{k}" for k in range(400, 500)]) for p in "abcd"]
    df = spark.createDataFrame([(p, k, list(range(len(k)))) for p, k in rows], "path string, keys array<string>, lines array<int>")
    tables = {}
    monkeypatch.setattr(clones, "stash", lambda df, name="table": tables.setdefault(name, stash(df, name)))
    assert clones.pairs(df, 10, 3).count() == 6
    assert tables["candidates"].count() < 80  # of 2,012


def test_tasks_do_not_grow_with_the_corpus(spark, tmp_path):
    """Eight files of one row group each, enough for the cores: more tasks, where they hold more than a task should."""
    from srcintel.operators.facts import spread

    c = spark.range(4000).selectExpr("concat('m', id, '.py') as path", "concat('x = ', id, '\n') as source")
    c.repartition(8).write.parquet(f"{tmp_path}/c")
    rows = spark.read.parquet(f"{tmp_path}/c")
    size = sum(p.stat().st_size for p in (tmp_path / "c").glob("*.parquet"))
    assert spread(rows, task=size // 30).rdd.getNumPartitions() >= 30
    assert spread(rows, task=size).rdd.getNumPartitions() < 30
