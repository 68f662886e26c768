"""Dependencies between tasks: acyclic edges, reachability, lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import discard, staged
from .chains import split_hot

# --- Fixed values ----------------------------------------------------------------------
DEPENDS_THRESHOLD = 0.5
NO_DEPENDENCIES = "no dependencies"
# ---------------------------------------------------------------------------------------
#: Nodes of a component up to which a table of who reaches whom is held: 2 bits a pair, 64 MB.
CLOSURE_NODES = 16_384


def _core(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges that may lie on a cycle, edges that cannot): an edge out of a node without
    incoming edges, or into one without outgoing edges, closes nothing."""
    at = [*keys, "a", "b"]
    sources = edges.select(*keys, F.col("b").alias("a")).distinct()
    sinks = edges.select(*keys, F.col("a").alias("b")).distinct()
    core = edges.join(sources, [*keys, "a"], "left_semi").join(sinks, [*keys, "b"], "left_semi").select(*edges.columns)
    return core, edges.join(core.select(*at).distinct(), at, "left_anti").select(*edges.columns)


def strong_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) for the nodes of edges ``a -> b`` that lie on a cycle: nodes that reach each other
    have the same component, a struct. Null keys are not looked at.

    Each turn gives every node the least label that leads to it. Nodes of one such colour that
    also lead back to its owner are a component, found by the same steps backwards; what is left
    goes on, inside its colour. A step is one join and one aggregate, and jumps from a label to
    the label of its owner, so long chains take few steps.
    """
    left = staged(edges.filter("a != b").select(*keys, "a", "b").distinct(), "links")
    done, turn = [], 0
    while not left.isEmpty():
        ends = left.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
        # Labels are drawn anew, so that no order of names is a bad one for every turn.
        own = staged(ends.withColumn("label", F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("n"))), "labels")
        colour = _least(own, left, keys, "a", "b")
        at = [*keys, "node"]
        inside = left.join(colour.select(*keys, F.col("node").alias("a"), F.col("label").alias("la")), [*keys, "a"]).join(
            colour.select(*keys, F.col("node").alias("b"), F.col("label").alias("lb")), [*keys, "b"]).filter("la = lb").select(*keys, "a", "b")
        inside = staged(inside, "inside")
        back = _least(own, inside, keys, "b", "a")
        found = staged(colour.join(back.withColumnRenamed("label", "back"), at).filter("label = back").select(*at, F.col("label").alias("component")), "found")
        gone = found.select(*at)
        rest = inside.join(gone.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), [*keys, "b"], "left_anti")
        done.append(found)
        following = staged(rest.select(*keys, "a", "b"), "links")
        for old in (left, inside, own, colour, back):
            discard(old)
        left, turn = following, turn + 1
    if not done:
        label = F.struct(F.lit(0).cast("bigint").alias("h"), F.col("a").alias("n"))
        return edges.filter(F.lit(False)).select(*keys, F.col("a").alias("node"), label.alias("component"))
    return reduce(DataFrame.unionByName, done)


def _least(labels: DataFrame, edges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, node, label): the least of the labels of the nodes that lead to a node along ``edges`` from ``start`` to ``end``."""
    at = [*keys, "node"]
    now = labels
    while True:
        along = edges.join(now.withColumnRenamed("node", start), [*keys, start]).select(*keys, F.col(end).alias("node"), "label")
        owner = now.select(*keys, F.col("node").alias("__owner"), F.col("label").alias("__far"))
        jumped = now.withColumn("__owner", F.col("label.n")).join(owner, [*keys, "__owner"], "left").select(*at, F.least("label", "__far").alias("label"))
        new = staged(along.unionByName(jumped).groupBy(*at).agg(F.min("label").alias("label")), "labels")
        changed = not new.join(now.withColumnRenamed("label", "__old"), at).filter("label != __old").isEmpty()
        if now is not labels:
            discard(now)
        now = new
        if not changed:
            return now


def _tarjan(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The strongly connected component of each node (Tarjan, 1972), without recursion."""
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(nodes + 1)).tolist()
    index, low, component, at = [0] * nodes, [0] * nodes, [-1] * nodes, first[:-1].copy()
    count = found = 0
    open_: list[int] = []
    for root in range(nodes):
        path = [] if index[root] else [root]
        while path:
            v = path[-1]
            if not index[v]:
                count += 1
                index[v] = low[v] = count
                open_.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not index[w]:
                    path.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                while True:
                    w = open_.pop()
                    component[w] = found
                    if w == v:
                        break
                found += 1
    return np.array(component)


def _by_closure(nodes: int, a: list[int], b: list[int]) -> list[bool]:
    """Which edges are kept, by a table of who reaches whom: a look per edge, and every bit of the table is set once at most."""
    words = -(-nodes // 64)
    ahead, behind = (np.zeros((nodes, words), dtype=np.uint64) for _ in range(2))
    bit = np.uint64(1) << (np.arange(nodes, dtype=np.uint64) % np.uint64(64))
    word = np.arange(nodes) // 64
    for table in (ahead, behind):
        table[np.arange(nodes), word] = bit  # every node reaches itself

    def members(row: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))

    taken = []
    for x, y in zip(a, b):
        if ahead[y, word[x]] & bit[x]:
            taken.append(False)
            continue
        taken.append(True)
        if not ahead[x, word[y]] & bit[y]:
            before, after = members(behind[x] & ~behind[y]), members(ahead[y] & ~ahead[x])
            ahead[before] |= ahead[y]
            behind[after] |= behind[x]
    return taken


def _by_order(nodes: int, a: list[int], b: list[int]) -> list[bool]:
    """The same by a topological order kept up to date (Pearce and Kelly, 2006): memory is linear in the edges."""
    place = list(range(nodes))
    ahead: list[list[int]] = [[] for _ in range(nodes)]
    behind: list[list[int]] = [[] for _ in range(nodes)]

    def near(start: int, links: list[list[int]], inside: Callable[[int], bool]) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for w in links[todo.pop()]:
                if w not in seen and inside(place[w]):
                    seen.add(w)
                    todo.append(w)
        return seen

    taken = []
    for x, y in zip(a, b):
        low, high = place[y], place[x]
        if low <= high:
            later = near(y, ahead, lambda p: p <= high)
            if x in later:
                taken.append(False)
                continue
            moved = sorted(near(x, behind, lambda p: p >= low), key=place.__getitem__) + sorted(later, key=place.__getitem__)
            for v, p in zip(moved, sorted(place[v] for v in moved)):
                place[v] = p
        ahead[x].append(y)
        behind[y].append(x)
        taken.append(True)
    return taken


def _acyclic(a: pd.Series, b: pd.Series) -> np.ndarray:
    """For the edges of one key in order whether each is kept: not if kept ones lead from its end to its beginning."""
    codes, names = pd.factorize(pd.concat([a, b], ignore_index=True))
    x, y = codes[:len(a)], codes[len(a):]
    component = _tarjan(len(names), x, y)
    taken = x != y
    inside = np.flatnonzero(taken & (component[x] == component[y]))
    inside = inside[np.argsort(component[x[inside]], kind="stable")]  # an edge between components closes nothing
    cuts = np.flatnonzero(np.diff(component[x[inside]])) + 1
    for part in np.split(inside, cuts) if len(inside) else []:
        own, local = np.unique(np.concatenate([x[part], y[part]]), return_inverse=True)
        decide = _by_closure if len(own) <= CLOSURE_NODES else _by_order
        taken[part] = decide(len(own), local[:len(part)].tolist(), local[len(part):].tolist())
    return taken


def acyclic_edges(edges: DataFrame, keys: list[str], threshold: float = DEPENDS_THRESHOLD) -> DataFrame:
    """Edges ``a -> b`` with p at or above ``threshold``, most certain first (then by ``ord``),
    without those that close a cycle with more certain ones. A null key is a key like others.

    Edges at the rim, which cannot lie on a cycle, are kept by joins. Of a key whose other edges
    do not fit a task, the strongly connected components are found by joins; edges between them
    are kept, and each component is a group of its own. A group is decided in order of certainty
    by one task, component by component, with a look per edge: the limit is a component whose
    edges do not fit a task.
    """
    named = F.to_json(F.struct(*[F.col(k).cast("string") for k in keys]))
    core, free = _core(staged(edges.filter(F.col("p") >= threshold).withColumn("__key", named), "edges"), ["__key"])
    schema = edges.schema
    core = core.withColumn("__part", F.lit(None).cast("bigint"))
    small, hot = split_hot(core, ["__key"])
    if hot is not None:
        hot = staged(hot.drop("__part"), "hot-edges")
        parts = staged(strong_components(hot, ["__key"]), "components")
        end = lambda c: parts.select("__key", F.col("node").alias(c), F.xxhash64("component").alias(f"__{c}"))
        met = hot.join(end("a"), ["__key", "a"], "left").join(end("b"), ["__key", "b"], "left")
        same = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
        free = free.unionByName(met.filter(~same & (F.col("a") != F.col("b"))).select(*free.columns))
        small = small.unionByName(met.filter(same).withColumn("__part", F.col("__a")).select(*small.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the group at the end of a batch may go on in the next one
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            new = rows["__key"].ne(rows["__key"].shift()) | rows["__part"].fillna(0).ne(rows["__part"].shift().fillna(0))
            number = new.cumsum().to_numpy()
            rest = rows[number == number[-1]] if len(rows) else rows
            for _, group in rows[number != number[-1]].groupby(number[number != number[-1]]):
                yield group[_acyclic(group["a"], group["b"])].drop(columns=["__key", "__part"])
        if rest is not None and len(rest):
            yield rest[_acyclic(rest["a"], rest["b"])].drop(columns=["__key", "__part"])

    group = ["__key", "__part"]
    ordered = small.withColumn("__np", -F.col("p")).repartition(*group).sortWithinPartitions(*group, "__np", "ord")
    kept = ordered.select(*edges.columns, *group).mapInPandas(run, schema)
    return kept.unionByName(free.select(*kept.columns))


def reaches(edges: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target, reached) for the pairs ``asked(keys, source, target)``: do edges
    ``a -> b`` lead from one to the other? A node reaches itself.

    One join per hop; only nodes seen for the first time go on, and a source stops once all its
    targets are found. Tables that a hop replaces are deleted.
    """
    pair = [*keys, "source", "target"]
    links = staged(edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("__to")).distinct(), "links")
    pairs = staged(asked.select(*pair).distinct(), "asked")
    seen = staged(pairs.select(*keys, "source", F.col("source").alias("node")).distinct(), "seen")
    front, found = seen, staged(pairs.filter("source = target"), "found")
    while True:
        open_ = pairs.join(found, pair, "left_anti").select(*keys, "source").distinct()
        ahead = front.join(open_, [*keys, "source"], "left_semi").join(links, [*keys, "node"]).select(
            *keys, "source", F.col("__to").alias("node")).distinct()
        new = staged(ahead.join(seen, [*keys, "source", "node"], "left_anti"), "front")
        if not new.limit(1).count():
            break
        hits = pairs.join(new.withColumnRenamed("node", "target"), pair, "left_semi")
        more, all_seen = staged(found.unionByName(hits.select(*pair)), "found"), staged(seen.unionByName(new), "seen")
        for old in {id(t): t for t in (front, found, seen)}.values():
            discard(old)
        front, found, seen = new, more, all_seen
    return pairs.join(found.withColumn("reached", F.lit(True)), pair, "left").select(*pair, F.coalesce("reached", F.lit(False)).alias("reached"))


def after(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, task, after, text): the tasks each task builds on, of one sheet."""
    lists = edges.groupBy(*keys, F.col("b").alias("task")).agg(F.array_sort(F.collect_set("a")).alias("after"))
    return lists.withColumn("text", F.concat(
        F.col("task").cast("string"), F.lit(" builds on "), F.array_join(F.col("after").cast("array<string>"), ", ")))


def dependency_text(edges: DataFrame, keys: list[str], sep: str = " → ", sheets: DataFrame | None = None) -> DataFrame:
    """(keys, text): "1 → 2, 2 → 3" per sheet; with ``sheets`` (keys) also those without edges, which say so. Null keys are keys."""
    pair = F.concat(F.col("a").cast("string"), F.lit(sep), F.col("b").cast("string"))
    ordered = F.array_sort(F.collect_set(F.struct("a", "b", pair.alias("t"))))
    texts = edges.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias("text"))
    if sheets is None:
        return texts
    bare = sheets.select(*keys).distinct().withColumn("text", F.lit(None).cast("string"))
    return texts.unionByName(bare).groupBy(*keys).agg(F.coalesce(F.max("text"), F.lit(NO_DEPENDENCIES)).alias("text"))


def question_load(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tasks, pairs): how many ordered pairs of tasks a sheet asks about. The pairs
    themselves are never formed here; their answers arrive as edges."""
    n = F.col("tasks")
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks")).withColumn("pairs", n * (n - 1))
