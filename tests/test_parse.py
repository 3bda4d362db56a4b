"""Facts of single sources."""

import pytest

from srcintel.functions.parse import DEEP, MAIN, PLAIN, TOP, WALK, complexity, parse, tokens


def raws(source):
    return [(i[0], i[2]) for i in parse(source)["imports"]]


def unused(source):
    f = parse(source)
    return [b[0] for b in f["bindings"] if not b[5] and not any(r[0] == b[0] and not b[3] <= r[1] < b[4] for r in f["refs"])]


def test_imports():
    assert raws("from foo.bar import baz\nimport a.b as c\nfrom x import *") == [("foo.bar", 0), ("foo.bar.baz", 0), ("a.b", 0), ("x", 0)]
    assert raws("from . import sibling\nfrom ..pkg import thing") == [("sibling", 1), ("pkg", 2), ("pkg.thing", 2)]
    assert raws("def f():\n    class A:\n        while x:\n            import deep\n") == [("deep", 0)]


@pytest.mark.parametrize(
    "source, flags",
    [
        ("if TYPE_CHECKING:\n    import a\nelse:\n    import b\n", [(True, True), (False, False)]),
        ("if typing.TYPE_CHECKING:\n    import a\n", [(True, True)]),
        ("try:\n    import a\nexcept ImportError:\n    import b\n", [(True, False), (True, False)]),
        ("try:\n    import a\nexcept (KeyError, ModuleNotFoundError):\n    pass\n", [(True, False)]),
        ("try:\n    import a\nexcept KeyError:\n    import b\n", [(False, False), (True, False)]),
        ("try:\n    import a\nexcept* ImportError:\n    import b\n", [(False, False), (False, False)]),
    ],
)
def test_import_flags(source, flags):
    assert [i[3:] for i in parse(source)["imports"]] == flags


@pytest.mark.parametrize(
    "source, names",
    [
        ('import os\nprint("os")\n', ["os"]),
        ("import os; print(os.getcwd())\n", []),
        ("import os.path\nos\n", []),
        ("from m import User\ndef f(x: 'User'): ...\n", []),
        ("from m import User\nprint('User')\n", ["User"]),
        ("from m import User\nx: 'list[User]' = 1\n", []),
        ("from m import A, B, C, D, E\n__all__ = ['A']\n__all__ += ('B',)\n__all__.extend(['C'])\n__all__.append('D')\nif x:\n    __all__: list = ['E']\n", []),
        ("from m import Flask as Flask\nimport y as y\n", []),
        ("from __future__ import annotations\n", []),
        ("import os  # noqa\nfrom a import (\n    b,  #NOQA: F401\n    c,\n)\n", []),
        ("import os\nx = f'{os.sep}'\n", []),
        ("import os\nx = f'{1:{os.sep}}'\n", ["os"]),
        ("import a\nmatch x:\n    case a.B(): ...\n", []),
        ("import a\nos = 'é'; a\n", []),
        ("import a as b\nb = 1\n", []),
    ],
)
def test_unused(source, names):
    assert unused(source) == names


def test_flags_of_modules():
    assert parse("if '__main__' == __name__: ...")["is_script"]
    assert not parse("if __name__ != '__main__': ...")["is_script"]
    assert parse("async def __getattr__(n): ...")["has_getattr"] and parse("__getattr__: int = 1")["has_getattr"]
    assert not parse("class A:\n    def __getattr__(self): ...")["has_getattr"]


def test_errors_are_facts():
    assert parse("def\n")["error"]
    assert parse("x" + "(" * 5000)["error"]
    assert parse("a\0b")["error"]
    assert parse(None)["error"] is None and parse("")["imports"] == []
    deep = "if x:\n" + "".join(" " * k + "if x:\n" for k in range(1, 90)) + " " * 90 + "pass\n"
    assert parse(deep)["error"] is None


def test_complexity():
    import ast

    def of(s):
        return complexity(ast.parse(s).body[0].body)

    assert of("def f():\n    pass") == (1, 0)
    assert of("def f():\n    if a and b or c:\n        for x in y:\n            if z: pass\n") == (6, 6)
    assert of("def f():\n    if a: pass\n    elif b: pass\n    else: pass\n") == (3, 2)
    assert of("def f():\n    def g():\n        if a: pass\n") == (1, 0)
    assert of("def f():\n    try: pass\n    except A: pass\n    except B: pass\n    finally:\n        if a: pass\n") == (4, 3)
    assert of("def f():\n    match a:\n        case 1: pass\n        case _: pass\n") == (2, 1)
    assert of("def f():\n    for a in b: pass\n    else:\n        if c: pass\n") == (2, 1)


def test_scopes():
    def scope(source, role="value"):
        return next(s[1] for s in parse(source)["sites"] if s[0] == role)

    assert scope("x = A()") == WALK | DEEP | MAIN | PLAIN | TOP
    assert scope("class B:\n    x = A()") == WALK | DEEP | MAIN
    assert scope("for i in j:\n    x = A()") == WALK
    assert scope("try: pass\nexcept E: pass\nelse:\n    x = A()") == WALK | DEEP
    assert scope("with a:\n    x = A()") == WALK | DEEP | MAIN | PLAIN


def test_tokens():
    assert tokens("x = f'a{b}c' + 1  # no\n\n") == [("name", "x", 1), ("op", "=", 1), ("string", "f'a{b}c'", 1), ("op", "+", 1), ("number", "1", 1), ("newline", "", 1)]
    assert [k for k, _, _ in tokens("if a:\n    b\n")] == ["op", "name", "op", "newline", "indent", "name", "newline", "dedent"]
    assert tokens("x = (\n")[:2] == [("name", "x", 1), ("op", "=", 1)]


def test_equal_short_sources_are_parsed_once(monkeypatch):
    from srcintel.functions import parse as module

    source = "import os\nx = os.environ.get('FEATURE_ONCE')\n"
    first = module.parse(source, ("imports", "sites"))
    monkeypatch.setattr(module, "_Module", None)
    assert module.parse(source, ("imports", "sites")) == first and first["sites"]
