"""A project on disk: package roots, pyproject files, git, owners. Small tables, read on the driver."""

from __future__ import annotations

import re
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from srcintel.operators.deadcode import Project
from srcintel.sources.config import Config


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text())
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return {}


def _children(root: Path) -> list[Path]:
    return sorted(p for p in root.iterdir() if p.is_dir() and not p.name.startswith("."))


def package_roots(root: str | Path, config: Config) -> list[str]:
    """Relative package roots: the configured ones, or src/ if it isn't a package, or the workspace's members, or the root."""
    root = Path(root)
    if config.package_roots:
        return [p.strip("/") or "." for p in config.package_roots]
    if (root / "src").is_dir() and not (root / "src/__init__.py").exists():
        return ["src"]
    members = [p for p in _children(root) if (p / "pyproject.toml").exists()]
    top = _toml(root / "pyproject.toml")
    if not members or "project" in top or "srcintel" in top.get("tool", {}):
        return ["."]
    roots = [f"{m.name}/src" if (m / "src").is_dir() and not (m / "src/__init__.py").exists() else m.name for m in members]
    seen: dict[str, str] = {}
    for r in roots:
        for x in _children(root / r) + sorted((root / r).glob("*.py")):
            if (x.is_file() or any(x.glob("*.py"))) and x.name not in ("setup.py", "conftest.py", "tests", "test", "docs", "examples", "scripts"):
                if x.stem in seen and seen[x.stem] != r:
                    raise ValueError(f"both {seen[x.stem]} and {r} hold a top-level module {x.stem}; set packageRoots")
                seen[x.stem] = r
    return roots


def dependency_name(requirement: str) -> str:
    return re.split(r"[<>=!~;@\[ ]", requirement.strip(), maxsplit=1)[0].strip()


def pyprojects(root: str | Path, roots: list[str]) -> tuple[list[str], list[tuple], list[tuple]]:
    """(project names, (owner_path, name, source), (module, group)) of the root's and the package roots' pyproject files."""
    root = Path(root)
    names, deps, scripts = [], [], []
    folders = dict.fromkeys([".", *roots, *(str(Path(r).parent) for r in roots if Path(r).name == "src")])
    for folder in folders:
        table = _toml(root / folder / "pyproject.toml")
        project = table.get("project", {})
        if name := project.get("name"):
            names.append(name)
        found = [(dependency_name(d), "project.dependencies") for d in project.get("dependencies", [])]
        found += [(d, "tool.poetry.dependencies") for d in table.get("tool", {}).get("poetry", {}).get("dependencies", {}) if d != "python"]
        deps += [(folder, n, s) for n, s in found if n]
        groups = {"scripts": project.get("scripts", {}), "gui-scripts": project.get("gui-scripts", {}), **project.get("entry-points", {})}
        scripts += [(target.split(":")[0].strip(), g) for g, entries in groups.items() for target in entries.values() if ":" in target]
    return list(dict.fromkeys(names)), deps, scripts


def project(spark: SparkSession, root: str | Path, config: Config) -> Project:
    roots = package_roots(root, config)
    names, deps, scripts = pyprojects(root, roots)
    return Project(
        roots=roots, entry_points=config.entry_points, plugins=config.plugins, names=names,
        dependencies=spark.createDataFrame(deps, "owner_path string, name string, source string"),
        scripts=spark.createDataFrame(scripts, "module string, group string"),
    )


def _git(root: Path, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=300)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or "git failed")
    return [x for x in done.stdout.splitlines() if x.strip()]


def commits(spark: SparkSession, root: str | Path) -> DataFrame:
    """A row for each path of each commit, relative to root; empty without a repository."""
    root = Path(root)
    try:
        rows = [(x,) for x in _git(root, "log", "--name-only", "--pretty=format:", "--relative")]
    except (RuntimeError, OSError):
        rows = []
    return spark.createDataFrame(rows, "path string")


def changed(spark: SparkSession, root: str | Path, base: str = "main") -> DataFrame:
    """Paths that differ from the base and still exist; a failure of git is an error."""
    root = Path(root)
    return spark.createDataFrame([(x,) for x in _git(root, "diff", "--name-only", "--relative", f"{base}...HEAD") if (root / x).exists()], "path string")


def owner_rules(root: str | Path) -> list[tuple[str, list[str]]] | None:
    """Rules of the first CODEOWNERS file; None without one."""
    for at in ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"):
        if (p := Path(root) / at).exists():
            rows = [x.split() for x in p.read_text().splitlines() if x.strip() and not x.lstrip().startswith("#")]
            return [(r[0], r[1:]) for r in rows if len(r) > 1]
    return None
