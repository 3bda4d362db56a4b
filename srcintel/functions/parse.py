"""Source text to facts: the one step that runs Python on the executors.

parse(source) turns a module into flat lists (imports, bindings, identifier references, functions, sites, tokens);
every question about them is asked in DataFrame operations. Nothing here imports Spark or runs the source. A file
that can't be parsed gives its error as a fact, never an exception.

A site is a syntax-tree node that some rule may ask for: (role, scope, line, name, tail, text, n, flag, flag2,
block, ord). scope is a set of bits, which statement walks reach the site:

    WALK   all compound statements
    DEEP   functions, classes, if, try (all parts), with
    MAIN   the same, but of try only body and handlers
    PLAIN  MAIN without classes
    TOP    the module's own statements
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import tokenize
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

WALK, DEEP, MAIN, PLAIN, TOP = 1, 2, 4, 8, 16
EXITS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
WITHS = (ast.With, ast.AsyncWith)
TRIES = (ast.Try, ast.TryStar)
#: Statements without blocks, the frequent ones.
_FLAT = {ast.Import, ast.ImportFrom, ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Pass, ast.Raise, ast.Assert, ast.Delete, ast.Global, ast.Nonlocal, ast.Break, ast.Continue}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_NOQA = re.compile(r"# ?noqa", re.IGNORECASE)


def bodies(stmt: ast.stmt) -> list[tuple[str, list[ast.stmt]]]:
    """A statement's blocks in source order, with their slots."""
    if type(stmt) in _FLAT:
        return []
    if isinstance(stmt, (*FUNCTIONS, ast.ClassDef, *WITHS)):
        return [("body", stmt.body)]
    if isinstance(stmt, (ast.If, *LOOPS)):
        return [("body", stmt.body), ("orelse", stmt.orelse)]
    if isinstance(stmt, TRIES):
        return [("body", stmt.body), *(("handler", h.body) for h in stmt.handlers), ("orelse", stmt.orelse), ("finalbody", stmt.finalbody)]
    if isinstance(stmt, ast.Match):
        return [("case", c.body) for c in stmt.cases]
    return []


def inner_scope(stmt: ast.stmt, slot: str, scope: int) -> int:
    """The walks that go on into one of a statement's blocks."""
    scope &= ~TOP
    if isinstance(stmt, (*LOOPS, ast.Match, ast.TryStar)):
        return scope & WALK
    if isinstance(stmt, ast.Try) and slot in ("orelse", "finalbody"):
        return scope & (WALK | DEEP)
    if isinstance(stmt, ast.ClassDef):
        return scope & ~PLAIN
    return scope


def statements(block: list[ast.stmt], scope: int = WALK | DEEP | MAIN | PLAIN | TOP) -> Iterator[tuple[ast.stmt, int]]:
    """All statements, before their blocks, with the walks that reach them. Without recursion: nesting may be deep."""
    todo = [(s, scope) for s in reversed(block)]
    while todo:
        stmt, at = todo.pop()
        yield stmt, at
        if type(stmt) in _FLAT:
            continue
        for slot, body in reversed(bodies(stmt)):
            inside = inner_scope(stmt, slot, at)
            todo += [(s, inside) for s in reversed(body)]


def _arguments(args: ast.arguments, defaults: bool = True) -> list[ast.expr]:
    typed = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
    found = [a.annotation for a in typed if a.annotation]
    return found + [d for d in (*args.defaults, *args.kw_defaults) if d] * defaults


def _patterns(pattern: ast.pattern) -> Iterator[ast.expr]:
    """Expressions that a match pattern uses (names that it binds aren't)."""
    todo = [pattern]
    while todo:
        p = todo.pop()
        if isinstance(p, ast.MatchValue):
            yield p.value
        elif isinstance(p, ast.MatchMapping):
            yield from p.keys
        elif isinstance(p, ast.MatchClass):
            yield p.cls
            todo += p.kwd_patterns
        todo += getattr(p, "patterns", [])
        if isinstance(p, ast.MatchAs) and p.pattern:
            todo.append(p.pattern)


def own_expressions(stmt: ast.stmt) -> list[ast.expr]:
    """A statement's expressions, outside its blocks."""
    kind = type(stmt)
    if kind is ast.Expr:
        return [stmt.value]
    if kind is ast.Assign:
        return [*stmt.targets, stmt.value]
    if kind is ast.Import or kind is ast.ImportFrom:
        return []
    if isinstance(stmt, FUNCTIONS):
        return [*stmt.decorator_list, *_arguments(stmt.args), *filter(None, [stmt.returns])]
    if isinstance(stmt, ast.ClassDef):
        return [*stmt.decorator_list, *stmt.bases, *(k.value for k in stmt.keywords)]
    if isinstance(stmt, WITHS):
        return [e for i in stmt.items for e in (i.context_expr, i.optional_vars) if e]
    if isinstance(stmt, TRIES):
        return [h.type for h in stmt.handlers if h.type]
    if isinstance(stmt, ast.Match):
        return [stmt.subject, *(e for c in stmt.cases for e in (*_patterns(c.pattern), *filter(None, [c.guard])))]
    if isinstance(stmt, ast.TypeAlias):
        return [stmt.value, *(p.bound for p in stmt.type_params if isinstance(p, ast.TypeVar) and p.bound)]
    if isinstance(stmt, (ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal)):
        return []
    return [e for e in ast.iter_child_nodes(stmt) if isinstance(e, ast.expr)]


def expressions(roots: list[ast.expr]) -> Iterator[ast.expr]:
    """The expressions and all inside them; format specifications of f-strings aren't entered."""
    todo = list(reversed(roots))
    while todo:
        e = todo.pop()
        yield e
        kind = type(e)
        if kind is ast.Name or kind is ast.Constant:
            continue
        if kind is ast.Attribute:
            todo.append(e.value)
            continue
        if kind is ast.Call:
            todo += reversed([e.func, *e.args, *[k.value for k in e.keywords]])
            continue
        if kind is ast.FormattedValue:
            inside: list = [e.value]
        elif kind is ast.Lambda:
            inside = [*_arguments(e.args), e.body]
        else:
            inside = []
            for child in ast.iter_child_nodes(e):
                if isinstance(child, ast.expr):
                    inside.append(child)
                elif isinstance(child, ast.comprehension):
                    inside += [child.iter, child.target, *child.ifs]
                elif isinstance(child, ast.keyword):
                    inside.append(child.value)
        inside.reverse()
        todo += inside


def tail_name(e: ast.expr, subscripts: bool = False) -> str | None:
    """The last name of a callable or (with subscripts) a base class."""
    while True:
        if isinstance(e, ast.Call):
            e = e.func
        elif subscripts and isinstance(e, ast.Subscript):
            e = e.value
        else:
            return e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else None


def _text(e: ast.expr | None) -> str | None:
    return e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None


def _bool_ops(e: ast.expr) -> int:
    return len(e.values) - 1 + sum(map(_bool_ops, e.values)) if isinstance(e, ast.BoolOp) else 0


def complexity(body: list[ast.stmt]) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a function; nested functions and classes don't count."""
    cyclomatic, cognitive = 1, 0
    todo = [(s, 0) for s in body]
    while todo:
        s, depth = todo.pop()
        if type(s) in _FLAT:
            continue
        deeper: list[ast.stmt] = []
        level: list[ast.stmt] = []
        branches = 0
        if isinstance(s, (ast.If, ast.While)):
            branches, deeper, level = 1, s.body, s.orelse
            cyclomatic += _bool_ops(s.test)
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            branches, deeper = 1, s.body
        elif isinstance(s, ast.Try):
            branches = len(s.handlers)
            deeper = [*s.body, *(x for h in s.handlers for x in h.body)]
            level = [*s.orelse, *s.finalbody]
        elif isinstance(s, WITHS):
            deeper = s.body
        elif isinstance(s, ast.Match):
            wild = [isinstance(c.pattern, ast.MatchAs) and c.pattern.name is None and c.pattern.pattern is None for c in s.cases]
            branches = len(wild) - sum(wild)
            deeper = [x for c in s.cases for x in c.body]
        cyclomatic += branches
        cognitive += branches * (1 + depth)
        todo += [(x, depth + 1) for x in deeper] + [(x, depth) for x in level]
    return cyclomatic, cognitive


def _functions(block: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Functions that health reports: not those in match, except* groups, or the else of loops and try."""
    todo = list(reversed(block))
    while todo:
        s = todo.pop()
        if type(s) in _FLAT:
            continue
        if isinstance(s, FUNCTIONS):
            yield s
        if isinstance(s, ast.Try):
            inside = [*s.body, *(x for h in s.handlers for x in h.body), *s.finalbody]
        elif isinstance(s, ast.If):
            inside = [*s.body, *s.orelse]
        elif isinstance(s, (*FUNCTIONS, ast.ClassDef, *LOOPS, *WITHS)):
            inside = s.body
        else:
            inside = []
        todo += reversed(inside)


def _imports(block: list[ast.stmt]) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(raw, kind, level, conditional, type only) of each import specifier."""
    todo = [(s, False, False) for s in reversed(block)]
    while todo:
        s, conditional, typing = todo.pop()
        if isinstance(s, ast.Import):
            for a in s.names:
                yield a.name, "absolute", 0, conditional, typing
        elif isinstance(s, ast.ImportFrom):
            kind = "relative" if s.level else "absolute"
            if s.module:
                yield s.module, kind, s.level, conditional, typing
            for a in s.names:
                if a.name != "*":
                    yield f"{s.module}.{a.name}" if s.module else a.name, kind, s.level, conditional, typing
        if type(s) in _FLAT:
            continue
        inside: list[tuple] = []
        for slot, body in bodies(s):
            c, t = conditional, typing
            if isinstance(s, ast.If) and slot == "body" and (getattr(s.test, "id", None) or getattr(s.test, "attr", None)) == "TYPE_CHECKING":
                c = t = True
            elif isinstance(s, ast.Try) and (slot == "handler" or slot == "body" and any(_catches_import_error(h.type) for h in s.handlers)):
                c = True
            inside += [(x, c, t) for x in body]
        todo += reversed(inside)


def _catches_import_error(e: ast.expr | None) -> bool:
    if isinstance(e, ast.Tuple):
        return any(map(_catches_import_error, e.elts))
    return isinstance(e, ast.Name) and e.id in ("ImportError", "ModuleNotFoundError")


def _has_float(e: ast.expr) -> bool:
    """float in an annotation, through unions, subscripts and tuples."""
    if isinstance(e, ast.BinOp):
        return _has_float(e.left) or _has_float(e.right)
    if isinstance(e, ast.Subscript):
        return _has_float(e.value) or _has_float(e.slice)
    if isinstance(e, ast.Tuple):
        return any(map(_has_float, e.elts))
    return isinstance(e, ast.Name) and e.id == "float"


def _is_main_guard(s: ast.stmt) -> bool:
    if not (isinstance(s, ast.If) and isinstance(s.test, ast.Compare) and len(s.test.ops) == 1 and isinstance(s.test.ops[0], ast.Eq)):
        return False
    sides = (s.test.left, s.test.comparators[0])
    return any(isinstance(a, ast.Name) and a.id == "__name__" and _text(b) == "__main__" for a, b in (sides, sides[::-1]))


def _targets(s: ast.stmt) -> list[str]:
    found = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
    return [t.id for t in found if isinstance(t, ast.Name)]


#: Expressions that have sites of their own.
_TOLD = {ast.Compare, ast.Call, ast.Subscript}


class _Module:
    def __init__(self, source: str):
        self.source = source
        self.tree = ast.parse(source)
        self.sites: list[tuple] = []
        self._walked: list[tuple] = []

    @cached_property
    def raw(self) -> bytes:
        return self.source.encode("utf-8", "surrogatepass")

    @cached_property
    def newlines(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"\n", self.raw)]

    @cached_property
    def starts(self) -> list[int]:
        """A line of the tree starts after any line end; offsets count bytes."""
        return [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw))]

    @cached_property
    def has_noqa(self) -> bool:
        return _NOQA.search(self.source) is not None

    @cached_property
    def lines(self) -> list[str]:
        return self.source.split("\n")

    def walk(self) -> list[tuple[ast.stmt, int, list[ast.expr]]]:
        """Each statement with its scope and its own expressions, and all inside them."""
        if not self._walked:
            self._walked = [(s, scope, list(expressions(own_expressions(s)))) for s, scope in statements(self.tree.body)]
        return self._walked

    def offset(self, node: ast.AST) -> int:
        return self.starts[node.lineno - 1] + node.col_offset

    def end(self, node: ast.AST) -> int:
        return self.starts[node.end_lineno - 1] + node.end_col_offset

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.newlines, offset) + 1

    def site(self, role: str, scope: int, node: ast.AST | None, name=None, tail=None, text=None, n=None, flag=None, flag2=None, block=None, order=None) -> None:
        self.sites.append((role, scope, self.line(self.offset(node)) if node is not None else 1, name, tail, text, n, flag, flag2, block, order))

    def bindings(self) -> Iterator[tuple[str, str, int, int, int, bool]]:
        """(name, module, line, start, end, noqa) of each name that an import binds."""
        for s, _ in statements(self.tree.body):
            if isinstance(s, ast.Import):
                found = [(a.asname or a.name.split(".")[0], a.name) for a in s.names if a.asname != a.name]
            elif isinstance(s, ast.ImportFrom) and not (s.module == "__future__"):
                found = [(a.asname or a.name, f"{s.module}.{a.name}" if s.module else a.name) for a in s.names if a.name not in ("*", a.asname)]
            else:
                continue
            start, end = self.offset(s), self.end(s)
            first, last = self.line(start), self.line(end)
            noqa = self.has_noqa and any(_NOQA.search(x) for x in self.lines[first - 1 : last])
            for name, module in found:
                yield name, module, first, start, end, noqa

    def references(self) -> Iterator[tuple[str, int]]:
        """(name, offset): names, identifiers in the strings of annotations, and what __all__ lists."""
        for s, _, own in self.walk():
            for e in own:
                if type(e) is ast.Name:
                    yield e.id, self.offset(e)
            if isinstance(s, ast.AnnAssign):
                hints = [s.annotation]
            elif isinstance(s, FUNCTIONS):
                hints = [*_arguments(s.args, defaults=False), *filter(None, [s.returns])]
            else:
                hints = []
            for e in expressions(hints):
                if (t := _text(e)) is not None:
                    for name in _IDENTIFIER.findall(t):
                        yield name, self.offset(e)
            listed: list[ast.expr] = []
            if isinstance(s, (ast.Assign, ast.AnnAssign)) and "__all__" in _targets(s):
                listed = getattr(s.value, "elts", []) if isinstance(s.value, (ast.List, ast.Tuple)) else []
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name) and s.target.id == "__all__":
                listed = s.value.elts if isinstance(s.value, (ast.List, ast.Tuple)) else []
            elif isinstance(s, ast.Expr) and isinstance(c := s.value, ast.Call) and isinstance(c.func, ast.Attribute) and isinstance(c.func.value, ast.Name) and c.func.value.id == "__all__":
                if c.func.attr == "extend":
                    listed = [x for a in c.args if isinstance(a, (ast.List, ast.Tuple)) for x in a.elts]
                elif c.func.attr == "append":
                    listed = c.args
            for e in listed:
                if (t := _text(e)) is not None:
                    yield t, self.offset(e)

    def collect(self) -> list[tuple]:
        """All sites."""
        self._block(self.tree.body, None)
        for s, scope, own in self.walk():
            for e in own:
                if type(e) in _TOLD:
                    self._expression(e)
            if isinstance(s, (ast.Assign, ast.AnnAssign)) and s.value is not None:
                self._value("value", scope, s.value)
            if scope & TOP:
                for name in _targets(s):
                    self.site("top_assign", scope, s, name=name)
            if isinstance(s, ast.Expr):
                self._value("expr", scope, s.value)
            if isinstance(s, FUNCTIONS):
                self._function(s, scope)
            elif isinstance(s, ast.ClassDef):
                self._class(s, scope)
            elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                self.site("typed", scope, s, name=s.target.id, text="field", flag=_has_float(s.annotation))
            if isinstance(s, ast.Try):
                for h in s.handlers:
                    kind = "" if h.type is None else h.type.id if isinstance(h.type, ast.Name) else "?"
                    self.site("handler", scope, h, name=kind, flag=any(isinstance(x, ast.Raise) for x in h.body))
                    for x in h.body:
                        if isinstance(x, ast.Raise) and isinstance(x.cause, ast.Constant) and x.cause.value is None:
                            self.site("raise_from_none", scope, x)
            for slot, body in bodies(s):
                if not (isinstance(s, LOOPS) and slot == "orelse") and not isinstance(s, ast.TryStar):
                    self._block(body, s)
        return self.sites

    def _block(self, block: list[ast.stmt], of: ast.stmt | None) -> None:
        """The statements of blocks in which something may follow an exit."""
        if any(isinstance(s, EXITS) for s in block[:-1]):
            generator = isinstance(of, FUNCTIONS) and any(isinstance(e, (ast.Yield, ast.YieldFrom)) for x, _ in statements(of.body) for e in expressions(own_expressions(x)))
            number = len(self.sites)
            for k, s in enumerate(block):
                self.site("stmt", WALK, s, name=type(s).__name__, n=len(block), flag=isinstance(s, EXITS), flag2=generator, block=number, order=k)

    def _value(self, role: str, scope: int, e: ast.expr) -> None:
        call = isinstance(e, ast.Call)
        if (tail := tail_name(e)) is not None:
            self.site(role, scope, e, tail=tail, flag=call, flag2=call and isinstance(e.func, ast.Attribute))
        if isinstance(e, ast.List):
            for x in e.elts:
                if (tail := tail_name(x)) is not None:
                    self.site("list_item", scope, x, tail=tail)

    def _function(self, f: ast.FunctionDef | ast.AsyncFunctionDef, scope: int) -> None:
        if scope & TOP:
            self.site("top_def", scope, f, name=f.name)
        for d in f.decorator_list:
            target = d.func if isinstance(d, ast.Call) else d
            self.site("decorator", scope, d, tail=tail_name(d), flag=isinstance(target, ast.Attribute))
        a = f.args
        for d in (*a.defaults, *filter(None, a.kw_defaults)):
            call = d.func.id if isinstance(d, ast.Call) and isinstance(d.func, ast.Name) else None
            self.site("default", scope, d, name=type(d).__name__, tail=call)
        for p in (*a.posonlyargs, *a.args, *a.kwonlyargs):
            if p.annotation:
                self.site("typed", scope, p.annotation, name=p.arg, text="parameter", flag=_has_float(p.annotation))
        value = f.body[0].value if len(f.body) == 1 and isinstance(f.body[0], ast.Return) else None
        if isinstance(value, ast.Call):
            plain = not (a.vararg or a.kwarg or a.kwonlyargs or value.keywords or isinstance(value.func, ast.Attribute)) and all(isinstance(x, ast.Name) for x in value.args)
            given = ",".join(p.arg for p in (*a.posonlyargs, *a.args))
            self.site("forward", scope, f, name=f.name, tail=given, text=",".join(x.id for x in value.args) if plain else None, n=len(value.args))

    def _class(self, c: ast.ClassDef, scope: int) -> None:
        for b in c.bases:
            self.site("base", scope, b, tail=tail_name(b, subscripts=True))
        names = [x.name for x in c.body if isinstance(x, FUNCTIONS)]
        dunder = [x for x in names if x.startswith("__") and x.endswith("__")]
        methods = [x for x in names if x not in dunder]
        state = any(isinstance(x, (ast.Assign, ast.AnnAssign)) for x in c.body) or any(x in ("__init__", "__new__") for x in names)
        self.site("class", scope, c, name=c.name, tail=methods[0] if methods else None, n=len(methods), flag=not (c.bases or c.keywords or c.decorator_list), flag2=state or bool(dunder))
        for x in c.body:
            if isinstance(x, (ast.Assign, ast.AnnAssign)):
                for name in _targets(x):
                    self.site("class_attr", scope, x, tail=name)
                if isinstance(x.value, ast.Call):
                    self.site("class_value", scope, x, tail=tail_name(x.value))
                if isinstance(x, ast.AnnAssign):
                    self.site("class_hint", scope, x, tail=tail_name(x.annotation, subscripts=True))

    def _expression(self, e: ast.expr) -> None:
        if isinstance(e, ast.Compare):
            left = e.left
            model = isinstance(left, ast.Attribute) and isinstance(left.value, ast.Name) and left.value.id[:1].isascii() and left.value.id[:1].isupper()
            for op, right in zip(e.ops, e.comparators):
                if isinstance(right, ast.Constant) and (right.value is None or isinstance(right.value, bool)):
                    self.site("compare", WALK, right, name=type(op).__name__, text=str(right.value), flag=model)
            if len(e.ops) == 1 and isinstance(left, ast.Call) and isinstance(left.func, ast.Name) and isinstance(e.comparators[0], ast.Constant) and type(e.comparators[0].value) is int:
                self.site("call_compare", WALK, e, name=left.func.id, tail=type(e.ops[0]).__name__, text=str(e.comparators[0].value))
        elif isinstance(e, ast.Call):
            if isinstance(e.func, ast.Name):
                self.site("call", WALK, e, name=e.func.id)
            elif isinstance(e.func, ast.Attribute) and (key := _text(e.args[0] if e.args else None)) is not None:
                on = e.func.value
                self.site("method", WALK, e, name=e.func.attr, tail=on.attr if isinstance(on, ast.Attribute) else None, text=key)
        elif isinstance(e, ast.Subscript) and isinstance(e.value, ast.Attribute) and (key := _text(e.slice)) is not None:
            on = e.value.value
            self.site("subscript", WALK, e, name=e.value.attr, tail=on.id if isinstance(on, ast.Name) else on.attr if isinstance(on, ast.Attribute) else None, text=key)


_SOFT = {"match", "case", "type", "_"}


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line): name, number, string, op (and keywords), newline, indent, dedent. An f-string is one
    string; comments and blank lines are none. What can't be tokenised ends the list."""
    out: list[tuple[str, str, int]] = []
    depth, begun, held = 0, 0, []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            name = tokenize.tok_name[t.type]
            if name in ("FSTRING_START", "TSTRING_START"):
                if not depth:
                    begun, held = t.start[0], []
                depth += 1
            if depth:
                held.append(t.string)
                if name in ("FSTRING_END", "TSTRING_END"):
                    depth -= 1
                    if not depth:
                        out.append(("string", "".join(held), begun))
            elif name == "NAME":
                out.append(("op" if keyword.iskeyword(t.string) else "name", t.string, t.start[0]))
            elif name == "NUMBER":
                out.append(("number", t.string, t.start[0]))
            elif name == "STRING":
                out.append(("string", t.string, t.start[0]))
            elif name == "OP":
                out.append(("op", t.string, t.start[0]))
            elif name in ("NEWLINE", "INDENT", "DEDENT"):
                out.append((name.lower(), "", t.start[0]))
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return out


def module_name_parts(error: BaseException) -> tuple[str, int]:
    return str(getattr(error, "msg", None) or error or type(error).__name__), int(getattr(error, "lineno", None) or 1)


EMPTY: dict = {"is_script": False, "has_getattr": False, "imports": [], "bindings": [], "refs": [], "functions": [], "sites": [], "tokens": [], "exports": []}


#: Characters of a source whose facts are kept for the next one like it: small files are often the same.
SHORT = 2000


def parse(source: str | None, parts: Iterable[str] = tuple(EMPTY)) -> dict:
    """The error, if there is one, and the facts asked for; with an error only those that need no syntax tree. Not to be changed."""
    source = source or ""
    return (_parsed_short if len(source) <= SHORT else _parsed)(source, tuple(parts))


def _parsed(source: str, parts: tuple[str, ...]) -> dict:
    facts: dict = {"error": None, **{p: EMPTY[p] for p in parts}}
    if "tokens" in facts:
        facts["tokens"] = tokens(source)
    try:
        m = _Module(source)
        body = m.tree.body
        told = {
            "is_script": lambda: any(map(_is_main_guard, body)),
            "has_getattr": lambda: any(isinstance(s, FUNCTIONS) and s.name == "__getattr__" or "__getattr__" in _targets(s) for s in body),
            "imports": lambda: list(_imports(body)),
            "bindings": lambda: list(m.bindings()),
            "refs": lambda: list(m.references()),
            "functions": lambda: [(f.name, m.line(m.offset(f)), *complexity(f.body)) for f in _functions(body)],
            "sites": m.collect,
            "exports": lambda: [s.name for s in body if isinstance(s, (*FUNCTIONS, ast.ClassDef))] + [n for s in body for n in _targets(s)],
        }
        facts.update({p: told[p]() for p in facts if p in told})
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        kept = {"tokens": facts["tokens"]} if "tokens" in facts else {}
        facts = {**facts, **{p: EMPTY[p] for p in facts if p in EMPTY}, **kept, "error": module_name_parts(e)[0]}
    return facts


_parsed_short = lru_cache(maxsize=1024)(_parsed)
