"""The commands: each opens a project and runs one query over it. python -m srcintel COMMAND [PATH] ..."""

from __future__ import annotations

import argparse
import configparser
import json
import sys
import time
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from srcintel.operators import clones, deadcode, health, post, smells
from srcintel.operators.facts import Facts
from srcintel.plans.report import FORMATS, render
from srcintel.sources import config as configuration
from srcintel.sources import project as projects
from srcintel.sources import pysource


class Workspace:
    """A project on disk, its configuration and its facts."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.config = configuration.load(root)
        self.project = projects.project(spark, root, self.config)
        self.corpus = pysource.read(spark, str(root), self.config.ignore_patterns, self.project.roots)
        self.facts = Facts(self.corpus)

    def check(self, circular_only: bool = False) -> DataFrame:
        if circular_only:
            return deadcode.circular(self.facts, self.project.roots)
        return deadcode.analyse(self.corpus, self.project, self.facts).issues

    def dupes(self, window: int = 50, min_unique: int = 6, mode: str = "mild", trace: str | None = None, skip_local: bool = False) -> DataFrame:
        found = clones.detect(self.facts, window, min_unique, mode)
        if trace:
            path, line = trace.rsplit(":", 1)
            found = clones.trace(found, path, int(line))
        return deadcode.wide(clones.skip_local(found) if skip_local else found)

    def health(self, **options) -> DataFrame:
        return deadcode.wide(health.issues(self.facts, projects.commits(self.spark, self.root), **options))

    def smells(self, todo_threshold: int = 5) -> DataFrame:
        c = self.config
        unknown = set(c.smells_disabled) - set(smells.RULES)
        if unknown:
            print(f"warning: no such smell: {', '.join(sorted(unknown))}", file=sys.stderr)
        return deadcode.wide(smells.issues(self.facts, c.smells_disabled, c.todo_threshold or todo_threshold, c.money_words))

    def flags(self) -> DataFrame:
        return deadcode.wide(smells.flags(self.facts))

    def audit(self, base: str = "main") -> DataFrame:
        """check, dupes, health and smells, on what changed since base."""
        found = self.check().unionByName(self.dupes()).unionByName(self.health()).unionByName(self.smells())
        return post.in_scope(found, projects.changed(self.spark, self.root, base))


def apply_post(w: Workspace, issues: DataFrame, args: argparse.Namespace) -> DataFrame:
    """noqa, then the baseline's issues go; what is saved is what is left."""
    issues = post.suppress(issues, post.suppressions(w.facts))
    if args.baseline:
        known = json.loads(Path(args.baseline).read_text())["fingerprints"]
        issues = post.without_baseline(issues, w.spark.createDataFrame([(k,) for k in known], "fingerprint string"))
    if args.save_baseline:
        rows = [r["fingerprint"] for r in post.baseline(issues).collect()]
        Path(args.save_baseline).write_text(json.dumps({"version": 1, "generated_at": f"epoch+{int(time.time())}", "fingerprints": rows}, indent=2))
    return issues


def extras(w: Workspace, issues: DataFrame, args: argparse.Namespace, out) -> None:
    score = post.score(issues)
    if args.score:
        r = score.first()
        print(f"score {r['value']} ({r['grade']}), deduction {r['deduction']:.1f}", file=out)
    if args.save_snapshot:
        r = score.first().asDict()
        body = {"version": 1, "generated_at": f"epoch+{int(time.time())}", "score": {"value": r.pop("value"), "grade": r.pop("grade")}, "breakdown": r}
        Path(args.save_snapshot).write_text(json.dumps(body, indent=2))
    if args.trend:
        old = json.loads(Path(args.trend).read_text())
        before = w.spark.createDataFrame([{**old["breakdown"], **old["score"]}], score.schema)
        for r in post.trend(score, before).orderBy("metric").collect():
            print(f"{r['metric']}: {r['before']} -> {r['now']} ({r['change']:+d})", file=out)
    if args.ownership:
        for r in post.ownership(issues, projects.owner_rules(w.root)).collect():
            print(f"{r['n']:6d}  {r['owners']}", file=out)


def init(root: Path, in_pyproject: bool, force: bool) -> str:
    """Writes a starting configuration."""
    body = 'packageRoots = ["{}"]\n'.format("src" if (root / "src").is_dir() else ".")
    if in_pyproject:
        at = root / "pyproject.toml"
        text = at.read_text() if at.exists() else ""
        if "[tool.srcintel]" in text and not force:
            raise FileExistsError("pyproject.toml has a [tool.srcintel] table")
        at.write_text(text.rstrip() + "\n\n[tool.srcintel]\n" + body)
    else:
        at = root / configuration.CONFIG_FILE
        if at.exists() and not force:
            raise FileExistsError(f"{at} exists")
        at.write_text(body)
    return str(at)


def migrate(kind: str, source: str) -> str:
    """Our configuration, from that of another tool."""
    text = Path(source).read_text()
    out = []
    if kind == "vulture":
        table = tomllib.loads(text).get("tool", {}).get("vulture", {})
        if x := table.get("exclude"):
            out.append(f"ignorePatterns = {json.dumps(x)}")
        if x := [p for p in table.get("paths", []) if p.endswith(".py")]:
            out.append(f"entryPoints = {json.dumps(x)}")
        if x := [p for p in table.get("paths", []) if not p.endswith(".py")]:
            out.append(f"packageRoots = {json.dumps(x)}")
    else:
        ini = configparser.ConfigParser()
        if source.endswith(".toml"):
            table = tomllib.loads(text).get("tool", {}).get("importlinter", {})
        else:
            ini.read_string(text)
            table = dict(ini["importlinter"]) if ini.has_section("importlinter") else {}
        packages = table.get("root_packages") or table.get("root_package", "")
        names = packages if isinstance(packages, list) else packages.split()
        out.append(f"# packages: {', '.join(names)}")
        out.append('packageRoots = ["."]')
    return "\n".join(out) + "\n"


CI = {
    "github": "name: srcintel\non: [pull_request]\njobs:\n  audit:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n        with: {fetch-depth: 0}\n      - run: python -m srcintel audit . --base origin/main\n",
    "gitlab": "srcintel:\n  script:\n    - python -m srcintel audit . --base origin/main\n",
}
GUIDE = """srcintel: check (dead code), dupes (clones), health (complexity, hotspots), smells, flags, audit (changed files only), list, fix, watch.
Exit status 1 when issues are left; audit: 1 on FAIL. --format json gives {issues, stats}; each issue has a type and its own fields.
Put `# noqa: CODE` on a line, or `# ruff: noqa` in a file, to suppress; --baseline FILE hides what was known."""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="srcintel")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, post_flags: bool = True, path: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if path:
            p.add_argument("path", nargs="?", default=".")
        p.add_argument("--format", choices=[*FORMATS, "toml"], default="human")
        if post_flags:
            for flag in ("--baseline", "--save-baseline", "--save-snapshot", "--trend"):
                p.add_argument(flag)
            for flag in ("--score", "--ownership"):
                p.add_argument(flag, action="store_true")
        return p

    add("check").add_argument("--circular-deps", action="store_true")
    p = add("dupes")
    p.add_argument("--window", type=int, default=50)
    p.add_argument("--min-unique", type=int, default=6)
    p.add_argument("--mode", choices=clones.MODES, default="mild")
    p.add_argument("--trace")
    p.add_argument("--skip-local", action="store_true")
    p = add("health")
    for flag, value in (("--cyclomatic", 10), ("--cognitive", 15), ("--maintainability", 30), ("--hotspot-top", 10), ("--top", None)):
        p.add_argument(flag, type=int, default=value)
    p.add_argument("--targets", action="store_true")
    p.add_argument("--effort", choices=("low", "medium", "high"))
    add("smells").add_argument("--todo-threshold", type=int, default=5)
    add("flags")
    add("watch")
    p = add("audit")
    p.add_argument("--base", default="main")
    p.add_argument("--max-issues", type=int, default=0)
    p = commands.add_parser("list")
    p.add_argument("what", choices=("all", "entry-points", "files", "plugins"))
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--format", choices=("human", "json"), default="human")
    p = add("fix", post_flags=False)
    p.add_argument("--write", action="store_true", help="rewrite the files (else: only say what would go)")
    p = add("init", post_flags=False)
    p.add_argument("--pyproject", action="store_true")
    p.add_argument("--force", action="store_true")
    add("config", post_flags=False)
    for name, choices in (("ci-template", ("github", "gitlab")), ("migrate", ("vulture", "import-linter"))):
        p = commands.add_parser(name)
        p.add_argument("kind", choices=choices)
        if name == "migrate":
            p.add_argument("input")
        p.add_argument("-o", "--output")
    commands.add_parser("llm")
    return top


def _emit(text: str, output: str | None) -> None:
    Path(output).write_text(text) if output else print(text, end="" if text.endswith("\n") else "\n")


def _list(w: Workspace, what: str, as_json: bool) -> str:
    a = deadcode.analyse(w.corpus, w.project, w.facts)
    lists: dict[str, list] = {}
    if what in ("all", "entry-points"):
        lists["entry_points"] = [r.asDict() for r in deadcode.inventory(a).orderBy("path").collect()]
    if what in ("all", "files"):
        lists["files"] = [r["path"] for r in a.modules.select("path").orderBy("path").collect()]
    if what in ("all", "plugins"):
        lists["plugins"] = [r["label"] for r in a.entries.where("source_kind = 'plugin'").select("label").distinct().orderBy("label").collect()]
    if as_json:
        return json.dumps(lists, indent=2)
    return "\n".join(f"{k}:\n" + "\n".join(f"  {x['path']}  ({x['sources']})" if isinstance(x, dict) else f"  {x}" for x in v) for k, v in lists.items())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "llm":
        print(GUIDE)
        return 0
    if args.command == "ci-template":
        _emit(CI[args.kind], args.output)
        return 0
    if args.command == "migrate":
        _emit(migrate(args.kind, args.input), args.output)
        return 0
    if args.command == "init":
        print(init(Path(args.path), args.pyproject, args.force))
        return 0
    if args.command == "config":
        c = configuration.load(args.path).as_dict()
        print(json.dumps(c, indent=2) if args.format == "json" else "\n".join(f"{k} = {json.dumps(v)}" for k, v in c.items() if v is not None))
        return 0
    began = time.time()
    spark = spark or SparkSession.builder.appName("srcintel").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    w = Workspace(spark, args.path)
    if args.command == "list":
        print(_list(w, args.what, args.format == "json"))
        return 0
    if args.command == "fix":
        unused = w.check().where("rule = 'unused-import'")
        for r in post.fixable(w.facts, unused).orderBy("path", "line").collect():
            print(f"{r['path']}:{r['line']}: {'remove' if r['fix'] else 'by hand'}: {r['name']}")
        if args.write:
            for r in post.fixed(w.facts, unused).toLocalIterator():
                (w.root / r["path"]).write_text(r["source"])
        return 0
    if args.command == "watch":
        from srcintel.streaming import watch

        def again(_: DataFrame) -> None:
            fresh = Workspace(spark, args.path)
            print(render(apply_post(fresh, fresh.check(), args), args.format, {}))

        watch.rerun(watch.changes(spark, args.path, w.config.ignore_patterns), again).awaitTermination()
        return 0
    if args.command == "check":
        found = w.check(args.circular_deps)
    elif args.command == "dupes":
        found = w.dupes(args.window, args.min_unique, args.mode, args.trace, args.skip_local)
    elif args.command == "health":
        found = w.health(cyclomatic=args.cyclomatic, cognitive=args.cognitive, maintainability=args.maintainability, hotspot_top=args.hotspot_top, top=args.top, targets=args.targets, effort=args.effort)
    elif args.command == "smells":
        found = w.smells(args.todo_threshold)
    elif args.command == "flags":
        found = w.flags()
    else:
        found = w.audit(args.base)
    found = apply_post(w, found, args).persist()
    n = found.count()
    stats = {"files_scanned": w.facts.modules().count(), "elapsed_ms": int(1000 * (time.time() - began))}
    print(render(found, args.format, stats))
    extras(w, found, args, sys.stderr if args.format in ("json", "sarif") else sys.stdout)
    if args.command == "audit":
        result = post.verdict(n, args.max_issues)
        print(result, file=sys.stderr)
        return int(result == "FAIL")
    return int(n > 0)
