"""Groups of similar items without all pairs: promises, components, verification in cells, components.

Items are distinct contents (copies were collapsed before), with keys of any orderable type. Whoever calls finds
promises, links between items whose signatures are near (a spanning forest of each bucket's near items is enough, as
only the components of the promises count). Then verified() takes each component of the promises:

1. one of at most 2 x `cell` items is a cell: its contents come together in one task, which verifies pairs, the
   likeliest first, unless they're connected already. A cell gives a spanning forest of the exact graph;
2. a larger one is sorted by the contents' own orders, one after another, and cut into runs of `cell` items, each of
   which is verified as a cell. Near-copies lie together in some order, so after these passes, linear in the
   component's size, most of it is connected;
3. whatever is still apart inside a large component is compared across: its connected parts are cut into chunks, small
   parts pooled, and every two chunks that aren't of one part meet in a cell. So every promising pair of a
   component that passes is inside a group, as if all pairs had been verified, and no task holds more than 2 x `cell` contents.

Only a large component whose items the first passes leave apart, in many small parts, costs pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcintel.llm.shared import ship, stash, tasks

#: Items of a bucket that one task compares by their signatures.
CELL = 2048
#: Items of a cell of which all near pairs are noted.
FEW = 16
#: Links that one task joins to components, of keys that are numbers and of others; more take distributed rounds.
LOCAL, LOCAL_OTHERS = 4_000_000, 1_000_000
ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string()}


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): root is the least node of its component."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    most = LOCAL if dict(edges.dtypes)["u"] == "bigint" else min(LOCAL, LOCAL_OTHERS)
    return _in_one_task(edges) if edges.limit(most + 1).count() <= most else _in_rounds(edges)


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Over at most LOCAL edges."""
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ends = [pa.chunked_array([b.column(c) for b in held]) for c in ("u", "v")]
        values = np.concatenate([x.to_numpy() for x in ends])
        del held, ends
        nodes, at = np.unique(values, return_inverse=True)
        del values
        root = _roots(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
        for lo in range(0, len(nodes), 100_000):
            some = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x, ARROW[kind]) for x in (nodes[some], nodes[root[some]])], ["node", "root"])

    return stash(edges.repartition(1).mapInArrow(run, f"node {kind}, root {kind}"), "components")


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component: roots are hooked to lesser ones, then all nodes point to their roots."""
    root = np.arange(n)
    while len(u):
        x, y = root[u], root[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Large-star and small-star rounds (Kiveris et al. 2014), each an aggregation and a join, written to the shared folder."""
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.union(least).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct()
    roots = roots.join(edges, roots["node"] == edges["u"], "left_anti")
    return stash(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root"))), "components")


def salted(buckets: DataFrame, most: int = 0) -> DataFrame:
    """(run, key, ...) of (bucket, key, ...): buckets of two items or more; one with more than `most` becomes a triangle of salted cells, so that every two
    of its items meet in some cell and none holds more than about 2 x `most`."""
    size = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    joined = buckets.join(size, "bucket").withColumn("parts", F.ceil(F.col("n") / (most or CELL)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int"))
    spread = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select(F.xxhash64("bucket", F.least("salt", "other"), F.greatest("salt", "other")).alias("run"), *[c for c in buckets.columns if c != "bucket"])


def by_run(batches: Iterator[pa.RecordBatch], column: str = "run", most: int = 0) -> Iterator[pa.RecordBatch]:
    """Whole cells from rows sorted by cell; most: of at most so many rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column)
        new = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) + 1
        cuts = [0, *new.tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1].column(column)[0].as_py() != ids[lo].as_py():
                yield _joined(held)
                held, size = [], 0
            while most and size + hi - lo >= most:
                held.append(batch.slice(lo, most - size))
                lo += most - size
                yield _joined(held)
                held, size = [], 0
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += hi - lo
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


#: Pairs of a cell that are compared at once, when one row after another finds few.
AT_ONCE = 1 << 16


def forest(signature: np.ndarray, near: Callable) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the graph of near signatures (breadth first). near(one or as many, many) -> mask."""
    left, queue = np.arange(len(signature)), []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        node = queue.pop()
        hit = near(signature[node], signature[left])
        for k in left[hit].tolist():
            yield node, k
            queue.append(k)
        found, left = int(hit.sum()), left[~hit]
        if 4 * found < len(left) + found and len(left) * (len(queue) + len(left)) <= AT_ONCE:
            rest = np.concatenate([np.array(queue, np.int64), left])
            x, y = np.nonzero(np.arange(len(rest))[:, None] < np.arange(len(queue), len(rest)))
            y += len(queue)
            some = near(signature[rest[x]], signature[rest[y]])
            x, y = x[some], y[some]
            one = np.maximum(x - len(queue) + 1, 0)  # the queue is connected
            for k in _forest_of(one.tolist(), (y - len(queue) + 1).tolist(), len(left) + 1):
                yield int(rest[x[k]]), int(rest[y[k]])
            return


def _forest_of(a: list[int], b: list[int], n: int) -> list[int]:
    """The numbers of the links (a, b) that connect what those before didn't."""
    parent = list(range(n))
    kept = []
    for k, (x, y) in enumerate(zip(a, b)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


def promises(cells: DataFrame, width: str, near: Callable) -> DataFrame:
    """(a, b): forests of the near pairs of cells, of all cells that a task has together. cells: run, key, signature. near(signatures,
    signatures) -> mask, row by row."""
    ship(cells.sparkSession)
    kind = dict(cells.dtypes)["key"]

    def close(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        run = rows.column("run").to_numpy()
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), width).reshape(len(run), -1)
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(first, len(run)))
        small = np.repeat(size <= FEW, size)
        a, b = [], []
        for d in range(1, FEW):
            i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:])) if d < len(run) else []
            if not len(i):
                break
            i = i[near(signature[i], signature[i + d])]
            a.append(i)
            b.append(i + d)
        for lo, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
            inside = signature[lo : lo + n]
            found = list(forest(inside, lambda one, many: near(np.broadcast_to(one, many.shape), many)))
            if found:
                x = lo + np.array(found)
                a.append(x[:, 0])
                b.append(x[:, 1])
        if a:
            keys = rows.column("key")
            node = keys.dictionary_encode().indices.to_numpy()
            x, y = np.concatenate(a), np.concatenate(b)
            kept = _forest_of(node[x].tolist(), node[y].tolist(), len(run))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(p[kept])) for p in (x, y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _joined([held, batch]) if held is not None else batch
            ids = rows.column("run").to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last run may go on
            if whole:
                yield from close(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None:
            yield from close(held)

    return cells.repartition(tasks(cells.sparkSession), "run").sortWithinPartitions("run", "key").mapInArrow(run, f"a {kind}, b {kind}")


def _pairs(rows: list[tuple], kind: str) -> pa.RecordBatch:
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, ARROW[kind]), pa.array(b, ARROW[kind])], ["a", "b"])


#: similar(pairs of positions) -> whether each is a true link.
Similar = Callable[[list[tuple[int, int]]], "list[bool]"]


#: Pairs that tree() goes through one by one before it leaves out what they connect.
STRETCH = 1024


def tree(a: np.ndarray, b: np.ndarray, find: Callable[[int], int]) -> np.ndarray:
    """The numbers of the pairs (a, b) that connect what those before didn't, nor find() does. A cell where most pairs promise has as many as the square of
    its items: after each stretch, twice as long as the one before, those that are connected by then go together."""
    if len(a) <= STRETCH:
        number: dict[int, int] = {}
        x, y = ([number.setdefault(find(k), len(number)) for k in p.tolist()] for p in (a, b))
        return np.array(_forest_of(x, y, len(number)), np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parts, label = np.unique(np.array([find(k) for k in nodes.tolist()]), return_inverse=True)
    x, y = label[at[: len(a)]], label[at[len(a) :]]
    left, kept, stretch = np.arange(len(a)), [], STRETCH
    while len(left):
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        some = _forest_of(x[:stretch].tolist(), y[:stretch].tolist(), len(parts))
        kept.append(left[some])
        root = _roots(x[some], y[some], len(parts))
        left, x, y = left[stretch:], root[x[stretch:]], root[y[stretch:]]
        stretch *= 2
    return np.concatenate(kept)


class _Cell:
    """The promising pairs of a cell that aren't tried yet, the likeliest first."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.wave = a, b, 0

    def take(self, find: Callable[[int], int]) -> list[tuple[int, int]]:
        """The pairs to try next, of those that aren't connected: first as many as would connect the cell if all succeeded,
        then, as most others fail, four times more in each wave."""
        if len(self.a) > 64:  # forget what is connected by now
            nodes = np.unique(np.concatenate([self.a, self.b]))
            label = np.array([find(k) for k in nodes.tolist()])
            apart = label[np.searchsorted(nodes, self.a)] != label[np.searchsorted(nodes, self.b)]
            self.a, self.b = self.a[apart], self.b[apart]
        out: list[tuple[int, int]] = []
        if self.wave:
            n = 16 << 2 * self.wave
            out = [(x, y) for x, y in zip(self.a[:n].tolist(), self.b[:n].tolist()) if find(x) != find(y)]
            self.a, self.b = self.a[n:], self.b[n:]
        else:
            tried = np.zeros(len(self.a), bool)
            tried[tree(self.a, self.b, find)] = True
            out = list(zip(self.a[tried].tolist(), self.b[tried].tolist()))
            self.a, self.b = self.a[~tried], self.b[~tried]
        self.wave += 1
        return out


def spanning(cuts: list[int], like: Callable[[np.ndarray, np.ndarray], np.ndarray], square: Callable[[int, int], np.ndarray], enough: float, similar: Similar, parts: list | None = None, sides: np.ndarray | None = None, cross: Callable[[int, int, int], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Links of spanning forests of the exact graphs of the cells cuts[k]:cuts[k + 1]: pairs that promise `enough` are tried, the
    likeliest first, unless they're connected already; those of all cells that come next are tried together. like(i, j): the promises of
    the pairs of rows i and j (arrays); square(lo, hi): those of all rows of a cell to one another. parts: rows of a cell with equal values are connected from the start.
    sides: of a cell with two of them, ascending, only pairs of one and the other are tried, whose promises cross(lo, middle, hi) gives."""
    n = cuts[-1]
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.diff(cuts)
    cell = np.repeat(np.arange(len(size)), size)
    if parts is not None:
        for lo, hi in zip(cuts, cuts[1:]):
            first: dict = {}
            for k in range(lo, hi):
                parent[k] = first.setdefault(parts[k], k)
    known = np.array(parent, np.int64)
    few = size <= FEW
    middle = [lo for lo in cuts[:-1]]  # where a cell's second side begins, if it has one
    if sides is not None:
        for k in (np.flatnonzero(sides[1:] != sides[:-1]) + 1).tolist():
            if cuts[cell[k]] != k:
                middle[cell[k]] = k
    two = np.array(middle)[cell] > np.array(cuts)[cell] if n else np.zeros(0, bool)
    second = np.arange(n) >= np.array(middle)[cell] if n else two
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    for d in range(1, min(FEW, n)):
        i = np.flatnonzero((cell[:-d] == cell[d:]) & few[cell[:-d]])
        if not len(i):
            break
        i = i[(known[i] != known[i + d]) & (~two[i] | (second[i] != second[i + d]))]
        value = like(i, i + d)
        hit = value >= enough
        found.append((i[hit], i[hit] + d, value[hit]))
    for k in np.flatnonzero(~few).tolist():
        lo, hi = cuts[k], cuts[k + 1]
        if (at := middle[k]) > lo and cross:
            value = cross(lo, at, hi)
            i, j = np.nonzero((value >= enough) & (known[lo:at, None] != known[at:hi]))
            found.append((i + lo, j + at, value[i, j]))
            continue
        value = square(lo, hi)
        i, j = np.nonzero(np.triu(value >= enough, 1) & (known[lo:hi, None] != known[lo:hi]))
        found.append((i + lo, j + lo, value[i, j]))
    if not found:
        return
    a, b, value = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-value, cell[a]))
    a, b = a[order], b[order]
    bound = np.flatnonzero(np.append(True, cell[a][1:] != cell[a][:-1])).tolist() if len(a) else []
    cells = [_Cell(a[lo:hi], b[lo:hi]) for lo, hi in zip(bound, [*bound[1:], len(a)])]
    while cells:
        wave = [pair for c in cells for pair in c.take(find)]
        for (i, j), ok in zip(wave, similar(wave)):
            if ok and (x := find(i)) != (y := find(j)):
                parent[x] = y
                yield i, j
        cells = [c for c in cells if len(c.a)]


#: links(rows, cuts, parts) -> pairs of positions: the verified links inside each cell cuts[k]:cuts[k + 1] of the rows, which are some
#: whole cells; parts as in spanning().
Links = Callable[[pa.RecordBatch, "list[int]", "list | None"], Iterator[tuple[int, int]]]
#: Rows whose signatures are prepared together.
TOGETHER = 4096


def _verify(rows: DataFrame, links: Links, kind: str, most: int = 0, column: str = "run") -> DataFrame:
    """rows sorted by `column` in their partitions -> (a, b); with a column `label`, what it connects isn't tried again."""
    labelled = "label" in rows.columns

    def verify(cells: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cells:
            return
        whole = _joined(cells)
        keys = whole.column("key").to_pylist()
        found = [(keys[i], keys[j]) for i, j in links(whole, np.cumsum([0, *(c.num_rows for c in cells)]).tolist(), whole.column("label").to_pylist() if labelled else None)]
        if found:
            yield _pairs(found, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for cell in by_run(batches, column, most):
            if cell.num_rows < 2:
                continue
            if held and size + cell.num_rows > TOGETHER:
                yield from verify(held)
                held, size = [], 0
            held.append(cell)
            size += cell.num_rows
        yield from verify(held)

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def verified(promised: DataFrame, contents: DataFrame, links: Links, orders: list[Column], cell: int = 1024) -> DataFrame:
    """(node, root) of all items in verified links. promised: (node, root), components of the promises, a table. contents: key and what
    links() needs of each promised item. orders: columns over contents that bring similar items together."""
    spark = promised.sparkSession
    ship(spark)
    kind, n = dict(promised.dtypes)["node"], tasks(spark)
    size = promised.groupBy("root").agg(F.count("*").alias("size"))
    # the components' sizes come along with the items, so that no content is exchanged twice for them
    sized = stash(promised.join(size, "root").select(F.col("node").alias("key"), "root", "size"), "sized")
    rows = sized.join(contents, "key")
    large = sized.where(F.col("size") > 2 * cell)
    if large.isEmpty():
        return components(_verify(rows.repartition(n, "root").sortWithinPartitions("root", "key"), links, kind, column="root"))
    rows = stash(rows, "contents")
    found = [_verify(rows.where(F.col("size") <= 2 * cell).repartition(n, "root").sortWithinPartitions("root", "key"), links, kind, column="root")]
    rest = rows.where(F.col("size") > 2 * cell).drop("size")
    labels = None
    for order in orders:
        here = rest.withColumn("order", order)
        if labels is not None:
            here = _labelled(here, labels)
        here = here.repartitionByRange(n, "root", "order").sortWithinPartitions("root", "order", "key").drop("order")
        more = stash(_verify(here, links, kind, cell, "root"), "verified")
        found.append(more)
        labels = components(more if labels is None else more.union(labels.select("node", "root")))
    across = _across(_labelled(sized.where(F.col("size") > 2 * cell).select("key", "root"), labels), cell)
    if not across.isEmpty():
        cells = across.join(rest.drop("root"), "key").repartition(n, "run").sortWithinPartitions("run", "side", "key")
        found.append(_verify(cells, links, kind))
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    return components(every)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their key: the root of what it is connected with, or itself."""
    known = labels.select(F.col("node").alias("key"), F.col("root").alias("label"))
    return rows.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _across(rows: DataFrame, cell: int) -> DataFrame:
    """(run, side, key, label): cells in which every two items of one root and different labels meet. Two chunks are the sides of a cell; the items of a chunk of the pool
    meet in a cell of one side, once. rows: key, root, label."""
    part = rows.groupBy("root", "label").agg(F.count("*").alias("n"))
    apart = part.groupBy("root").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") <= cell, F.col("n")).otherwise(0)).alias("pool"), F.collect_list(F.when(F.col("n") > cell, F.struct("label", F.ceil(F.col("n") / cell).cast("int").alias("parts")))).alias("big"))
    apart = apart.where("labels > 1").withColumn("pools", F.ceil(F.col("pool") / cell).cast("int"))
    # (label, number) of each chunk of a root; those of the pool have no label. A root of n items has n / cell of them.
    big = F.flatten(F.transform("big", lambda b: F.transform(F.sequence(F.lit(0), b["parts"] - 1), lambda k: F.struct(b["label"].alias("of"), k.alias("k")))))
    kind = dict(rows.dtypes)["label"]
    pool = F.when(F.col("pools") > 0, F.transform(F.sequence(F.lit(0), F.col("pools") - 1), lambda k: F.struct(F.lit(None).cast(kind).alias("of"), k.alias("k")))).otherwise(F.expr(f"cast(array() as array<struct<of: {kind}, k: int>>)"))
    chunks = apart.select("root", "pools", F.concat(big, pool).alias("chunks"))
    placed = rows.join(part, ["root", "label"]).join(chunks, "root")
    is_big = F.col("n") > cell
    own = F.struct(F.when(is_big, F.col("label")).alias("of"), F.when(is_big, F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / cell))).otherwise(F.pmod(F.xxhash64("key"), F.col("pools"))).cast("int").alias("k"))
    met = placed.withColumn("own", own).withColumn("other", F.explode("chunks")).where("not (own.of is not null and other.of is not null and own.of = other.of)")
    code = lambda c: F.xxhash64(f"{c}.of", f"{c}.k")
    return met.select(F.xxhash64("root", F.least(code("own"), code("other")), F.greatest(code("own"), code("other"))).alias("run"), code("own").alias("side"), "key", "label")
