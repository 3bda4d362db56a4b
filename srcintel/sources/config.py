"""Configuration: defaults, then the tool's TOML file or else [tool.srcintel] of pyproject.toml, then the ignore file."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from srcintel.operators.plugins import PLUGINS

CONFIG_FILE, IGNORE_FILE, TABLE = "srcintel.toml", ".srcintelignore", "srcintel"
IGNORED = [f"**/{x}/**" for x in ".venv venv .env __pycache__ .tox .nox build dist .pytest_cache .mypy_cache .ruff_cache site-packages .git .github .gitlab .circleci node_modules".split()]


@dataclass
class Config:
    package_roots: list[str] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=lambda: list(IGNORED))
    python_version: str | None = None
    plugins: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(PLUGINS, True))
    smells_disabled: list[str] = field(default_factory=list)
    todo_threshold: int | None = None
    money_words: list[str] = field(default_factory=list)

    def merge(self, table: dict) -> None:
        """Roots, entries and the version replace; ignore patterns are added; plugins are set one by one (a table without
        `enabled` disables); [smells] replaces."""
        self.package_roots = table.get("packageRoots", self.package_roots)
        self.entry_points = table.get("entryPoints", self.entry_points)
        self.python_version = table.get("pythonVersion", self.python_version)
        self.ignore_patterns = self.ignore_patterns + table.get("ignorePatterns", [])
        for name, body in table.get("plugins", {}).items():
            self.plugins[name] = bool(body.get("enabled", False)) if isinstance(body, dict) else bool(body)
        if (s := table.get("smells")) is not None:
            self.smells_disabled = s.get("disabled", [])
            self.todo_threshold = s.get("todo_threshold", s.get("todoThreshold"))
            self.money_words = s.get("money_words", s.get("moneyWords", []))

    def as_dict(self) -> dict:
        return asdict(self)


def load(root: str | Path) -> Config:
    root, config = Path(root), Config()
    if (own := root / CONFIG_FILE).exists():
        config.merge(tomllib.loads(own.read_text()))
    elif (project := root / "pyproject.toml").exists():
        try:
            config.merge(tomllib.loads(project.read_text()).get("tool", {}).get(TABLE, {}))
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{project}: {e}") from e
    if (ignore := root / IGNORE_FILE).exists():
        config.ignore_patterns += [x.strip() for x in ignore.read_text().splitlines() if x.strip() and not x.strip().startswith("#")]
    return config
