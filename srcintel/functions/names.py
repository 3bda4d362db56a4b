"""Column expressions on paths and module names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def components(path: Column) -> Column:
    return F.split(path, "/")


def directory(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def is_init(path: Column) -> Column:
    return file_name(path) == "__init__.py"


def dotted(path: Column, roots: list[str]) -> Column:
    """A module's dotted name below the first package root that holds it; empty if a part isn't an identifier."""
    below = path
    chain = None
    for root in roots:
        prefix = root.strip("./")
        if prefix:
            case = (path.startswith(prefix + "/"), F.substring(path, len(prefix) + 2, 1 << 20))
        else:
            case = (F.lit(True), path)
        chain = F.when(*case) if chain is None else chain.when(*case)
    if chain is not None:
        below = chain.otherwise(path)
    parts = F.split(F.regexp_replace(below, r"\.py$", ""), "/")
    parts = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(IDENTIFIER)), F.array_join(parts, ".")).otherwise(F.lit(""))


def is_pytest_entry(path: Column) -> Column:
    """Test modules by name, and type-checking fixtures by directory."""
    name = file_name(path)
    named = (name == "conftest.py") | name.rlike(r"^test_.+\.py$") | name.rlike(r"^.+_test\.py$")
    return named | (name.endswith(".py") & path.rlike(r"(^|/)(mypy/(modules|outputs)|typechecking)/"))


def is_test_adjacent(path: Column) -> Column:
    return is_pytest_entry(path) | (path.endswith(".py") & path.rlike(r"(^|/)(tests|test|testing)(/|$)"))


def glob_regex(glob: str) -> str:
    """A regular expression for a whole path: * and ? cross slashes, ** spans directories, [] and {} as usual."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = glob.find("]", i + 2)
            if j < 0:
                raise ValueError(f"open bracket in {glob!r}")
            body = glob[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = j
        elif c == "{":
            out.append("(?:")
        elif c == "}":
            out.append(")")
        elif c == "," and out.count("(?:") > out.count(")"):
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if out.count("(?:") != out.count(")"):
        raise ValueError(f"open brace in {glob!r}")
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Any of the globs; invalid ones are left out."""
    found = []
    for g in globs:
        try:
            found.append(glob_regex(g))
        except ValueError:
            continue
    return path.rlike("|".join(f"(?:{r})" for r in found)) if found else F.lit(False)
