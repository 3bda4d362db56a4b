"""Import graph: resolution, edges, reachability, parent packages, strongly connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcintel.functions.names import dotted, is_init
from srcintel.operators.facts import Facts, ship
from srcintel.storage import stash

#: Edges that one task may hold (some tens of bytes each); larger graphs take the distributed way.
LOCAL_EDGES = 1_000_000


def modules(f: Facts, roots: list[str]) -> DataFrame:
    """path, dotted, kind, imports of the parsed modules; written once, where the parse isn't kept."""
    path = F.col("path")
    rows = f.modules("imports").select("path", dotted(path, roots).alias("dotted"), F.when(is_init(path), "package").otherwise("module").alias("kind"), "imports")
    return rows if f.kept is not None else stash(rows, "modules")


def targets(mods: DataFrame) -> DataFrame:
    """dotted -> path, one for each name (the last path, where two files claim a name)."""
    return mods.where("dotted != ''").groupBy("dotted").agg(F.max("path").alias("target"))


def resolve(mods: DataFrame) -> DataFrame:
    """src, dst, is_type_only of each import that names a module of the corpus. A relative import starts at the
    package (of a module: its parent) less level - 1 parts; one that goes too far up resolves to nothing."""
    rows = mods.select("path", "dotted", F.col("kind").alias("kind_of_module"), F.inline("imports"))
    parts = F.split("dotted", r"\.")
    parts = F.when(F.col("dotted") == "", F.array().cast("array<string>")).otherwise(parts)
    keep = F.size(parts) - F.when(F.col("kind_of_module") == "package", 0).otherwise(1) - (F.col("level") - 1)
    base = F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0)).cast("int")), ".")
    relative = F.when(keep >= 0, F.concat_ws(".", F.when(base != "", base), "raw"))
    name = F.when(F.col("kind") == "relative", relative).otherwise(F.col("raw"))
    return rows.select(F.col("path").alias("src"), name.alias("dotted"), "is_type_only").join(targets(mods), "dotted").select("src", F.col("target").alias("dst"), "is_type_only")


def edges(mods: DataFrame) -> DataFrame:
    """Distinct src, dst; imports for type checkers only, and of a module itself, are none. A table: every question about the graph reads it."""
    return stash(resolve(mods).where("src != dst and not is_type_only").select("src", "dst").distinct(), "edges")


def _is_small(rows: DataFrame) -> bool:
    return rows.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def reachable(edge: DataFrame, start: DataFrame) -> DataFrame:
    """(path) of all nodes that the starts reach, and the starts. edge: src, dst, a table or cheap to compute; start: path."""
    start = stash(start.select("path").distinct(), "start")
    if _is_small(edge) and _is_small(start):
        return stash(_reach_in_one_task(edge, start), "reached")
    found, frontier, level = start, start, 0
    while not frontier.isEmpty():
        step = frontier.join(edge, frontier["path"] == edge["src"]).select(F.col("dst").alias("path")).distinct()
        frontier = stash(step.join(found, "path", "left_anti"), "frontier")
        found, level = found.union(frontier), level + 1
        if level % 16 == 0:  # else the plan would grow with every level
            found = stash(found, "reached")
    return found


def _reach_in_one_task(edge: DataFrame, start: DataFrame) -> DataFrame:
    """A breadth-first search in one task over at most LOCAL_EDGES edges; the graph never comes to the driver."""
    ship(edge.sparkSession)
    kind = dict(edge.dtypes)["src"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        todo: list = []
        type_ = None
        for b in batches:
            type_ = b.schema.field("dst").type
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
                todo.append(d) if s is None else out.setdefault(s, []).append(d)
        seen = set(todo)
        while todo:
            for d in out.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), type_)], ["path"])

    rows = edge.select("src", "dst").unionByName(start.select(F.lit(None).cast(kind).alias("src"), F.col("path").alias("dst")))
    return rows.repartition(1).mapInArrow(run, f"path {kind}")


def unreachable(mods: DataFrame, edge: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unreached paths, reached paths). The packages above a reached file count as reached, without what they import."""
    found = reachable(edge, entries.join(mods.select("path"), "path", "left_semi"))
    parts = F.split("dotted", r"\.")
    above = found.join(mods.where("dotted != ''"), "path").select(parts.alias("parts")).where("size(parts) > 1")
    names = above.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "."))).alias("dotted")).distinct()
    packages = names.join(targets(mods), "dotted").select(F.col("target").alias("path"))
    reached = found.union(packages).distinct()
    return mods.select("path").join(reached, "path", "left_anti"), reached


def _tarjan(adjacent: dict) -> Iterator[list]:
    """Strongly connected components of two nodes or more; without recursion."""
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    for root in adjacent:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(adjacent[root]))]
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(adjacent.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1:
                        yield part


def components(edge: DataFrame) -> DataFrame:
    """(node, root) of all nodes on cycles: root is the least node of the strongly connected component. edge: src, dst, a table or cheap to compute."""
    ship(edge.sparkSession)
    kind = dict(edge.dtypes)["src"]
    edge = edge.where("src != dst").select("src", "dst")
    if not _is_small(edge):
        return _components_distributed(edge.distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adjacent: dict = {}
        type_ = None
        for b in batches:
            type_ = b.schema.field("src").type
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
                adjacent.setdefault(s, []).append(d)
        rows = [(x, min(part)) for part in _tarjan(adjacent) for x in part]
        if rows:
            a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, type_)], ["node", "root"])

    return stash(edge.repartition(1).mapInArrow(run, f"node {kind}, root {kind}"), "components")


def _components_distributed(edge: DataFrame, turned: bool = False) -> DataFrame:
    """Nodes with a single edge out are followed to where they lead, in steps that double: those that stay among themselves end on cycles, which are
    components; the others' ends take over the edges into them, and the graph that is left (mostly a small one) is searched again. Where few nodes
    have a single edge, the graph is turned round, and where that doesn't help either, it is coloured. edge: distinct, no loops."""
    edge = stash(edge, "edges")
    out = stash(edge.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")), "degrees")
    n, singles = out.agg(F.count("*"), F.count_if(F.col("n") == 1)).first()
    if n == 0:
        return edge.select(F.col("src").alias("node"), F.col("src").alias("root"))
    if singles * 20 < n:
        return _coloured(edge) if turned else _components_distributed(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")), True)
    steps, final = _followed(out.where("n = 1").select(F.col("src").alias("node"), "to"))
    rings = final.where("on").select(F.col("was").alias("node")).distinct().join(final.select("node", F.col("least").alias("root")), "node")
    if singles == n:
        return stash(rings, "components")
    many = out.where("n > 1").select("src")
    ends = final.where("not on").select(F.col("node").alias("dst"), F.col("to").alias("end"))
    moved = edge.join(many, "src", "left_semi").join(ends, "dst", "left").select("src", "dst", F.coalesce("end", "dst").alias("end"))
    moved = stash(moved.join(many.select(F.col("src").alias("end")), "end", "left_semi"), "moved")
    rest = moved.where("src != end").select("src", F.col("end").alias("dst")).distinct()
    inner = stash(components(rest), "inner")
    # a followed node lies in its end's component if that component has an edge into it, or into one before it
    named = [inner.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "end")]
    into = moved.where("dst != end").join(named[0], "src", "left").join(named[1], "end", "left")
    into = into.select(F.col("dst").alias("node"), F.coalesce("src_root", "src").alias("of"), F.coalesce("end_root", "end").alias("root")).where("of = root")
    marked = stash(into.select("node", "root").distinct(), "marked")
    for step in steps:
        marked = stash(marked.union(marked.join(step, "node").select(F.col("to").alias("node"), "root")).distinct(), "marked")
    whole = inner.union(marked).distinct()
    least = whole.groupBy("root").agg(F.min("node").alias("least"))
    return stash(whole.join(least, "root").select("node", F.col("least").alias("root")).union(rings), "components")


def _followed(jump: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """jump: node, to, a row for each node. The steps (node, to) of 1, 2, 4 ... edges, and where they end: node, to; on: whether it goes on for ever,
    then was, which lies on a cycle (all of a cycle's nodes do so), and least, the least node of the cycle."""
    jump = stash(jump.withColumn("least", F.least("node", "to")), "jump")
    steps, before = [jump.select("node", "to")], None
    while True:
        further = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        both = jump.select("node", "to", "least").join(further, "to", "left")
        jump = stash(both.select("node", F.coalesce("to2", "to").alias("to"), F.least("least", "least2").alias("least"), F.col("to").alias("was"), F.col("to2").isNotNull().alias("on"), (F.col("least2") < F.col("least")).alias("less")), "jump")
        steps.append(jump.select("node", "to"))
        now = jump.where("on").agg(F.count("*"), F.countDistinct("was"), F.count_if("less")).first()
        # as many go on as before: all that do never stop. As many ends as before: the ends are a permutation of themselves, which are cycles
        if before is not None and now[:2] == before[:2] and now[2] == 0:
            return steps, jump
        before = now


def _coloured(edge: DataFrame) -> DataFrame:
    """Colouring: trim nodes without edges in or out; the greatest label that reaches a node colours it; the nodes of a
    colour that reach its owner, inside the colour, are the owner's component; repeat on the rest."""
    found = None
    edge = stash(edge)
    while True:
        while True:  # trim
            inner = edge.join(edge.select(F.col("src").alias("n")).distinct(), F.col("dst") == F.col("n"), "left_semi")
            inner = stash(inner.join(edge.select(F.col("dst").alias("n")).distinct(), F.col("src") == F.col("n"), "left_semi"))
            if inner.count() == edge.count():
                break
            edge = inner
        if edge.isEmpty():
            break
        colour = stash(edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = edge.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("new"))
            both = colour.join(pushed, F.col("node") == F.col("dst"), "left").select("node", "colour", F.greatest("colour", F.coalesce("new", "colour")).alias("better"))
            both = stash(both)
            changed = not both.where("better != colour").isEmpty()
            colour = both.select("node", F.col("better").alias("colour"))
            if not changed:
                break
        inside = edge.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        inside = stash(inside)
        members = stash(colour.where("node = colour"))
        frontier = members
        while not frontier.isEmpty():  # backwards from the owners
            back = inside.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = stash(back.join(members, "node", "left_anti"))
            members = stash(members.union(frontier))
        found = members if found is None else stash(found.union(members))
        edge = edge.join(members.select(F.col("node").alias("src")), "src", "left_anti")
        edge = stash(edge.join(members.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return edge.select(F.col("src").alias("node"), F.col("src").alias("root"))
    whole = Window.partitionBy("colour")
    return found.withColumn("n", F.count("*").over(whole)).where("n > 1").select("node", F.min("node").over(whole).alias("root"))


def cycles(edge: DataFrame) -> DataFrame:
    """cycle (sorted members) of each strongly connected component."""
    return components(edge).groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("cycle")).select("cycle")
