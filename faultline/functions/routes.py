"""Paths from every vertex of a graph that fits a task: numbered arcs in every task, blocks of roots dealt out.

Vertices are numbered by component, then by id, so the arcs of a component are one stretch and a block of its
roots holds (root, vertex) cells of that component only. A cell is met once and an arc walked once a root (more
often where lengths are improved), whatever the number of levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: (root, vertex) cells and (root, arc) pairs of a block, at most, unless a single root has more.
CELLS = 2_000_000
#: The same where many passes go over a block: what they touch stays in a core's cache.
NEAR_CELLS = 500_000


@dataclass(frozen=True)
class Numbered:
    """Arcs ``src -> dst`` between places of ``ids``, by source; ``comp`` is each place's component, ascending."""

    ids: pa.Array
    comp: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray

    @property
    def n(self) -> int:
        return len(self.ids)

    def sizes(self) -> np.ndarray:
        """Vertices of each component."""
        return np.bincount(self.comp)

    def blocks(self, cells: int | None = None) -> list[tuple[int, int]]:
        """Stretches of roots, each within a component."""
        cells = CELLS if cells is None else cells
        out, at, sizes = [], 0, self.sizes()
        arcs = np.bincount(self.comp[self.src], minlength=len(sizes))
        for size, m in zip(sizes.tolist(), arcs.tolist()):
            step = max(1, min(cells // max(size, m), -(-size // 8)))
            out += [(k, min(k + step, at + size)) for k in range(at, at + size, step)]
            at += size
        return out

    def around(self, root: int) -> Walk:
        """The component of a root, for walks in it."""
        lo, hi = np.searchsorted(self.comp, [self.comp[root], self.comp[root] + 1])
        a, b = np.searchsorted(self.src, [lo, hi])
        return Walk(int(lo), int(hi - lo), np.searchsorted(self.src[a:b], np.arange(lo, hi + 1)), self.dst[a:b] - lo, self.weight[a:b])


def fits(g) -> bool:
    return max(g.vertices.count(), g.edges.count() * (1 if g.directed else 2)) <= kernels.MAX_EDGES


def weak_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least vertex connected with each: the lesser label hooks the greater root, then pointers are doubled."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def numbered(g) -> Numbered:
    """The arcs of a graph that ``fits``; arcs from or to what is no vertex are left out."""
    ids = _column(g.vertices.select(F.col("id").cast("string").alias("id")).distinct().toArrow(), "id")
    ids = ids.take(pc.sort_indices(ids))
    arcs = g.arcs().select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight").toArrow()
    src, dst = (np.asarray(pc.index_in(_column(arcs, c), value_set=ids).fill_null(-1)).astype(np.int64) for c in ("src", "dst"))
    known = (src >= 0) & (dst >= 0)
    src, dst, weight = src[known], dst[known], np.asarray(_column(arcs, "weight"), dtype=float)[known]
    comp = np.unique(weak_components(len(ids), src, dst), return_inverse=True)[1]
    order = np.argsort(comp, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    src, dst = place[src], place[dst]
    by = np.lexsort((dst, src))
    return Numbered(ids.take(pa.array(order)), comp[order], src[by], dst[by], weight[by])


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.cast(pa.string()) if pa.types.is_large_string(c.type) else c


def from_blocks(g, graph: Numbered, function: Callable[[Numbered, Iterator[tuple[int, int]]], Iterator[dict]], schema: str, blocks: list[tuple[int, int]] | None = None) -> DataFrame:
    """Run ``function(graph, blocks)`` over all blocks of roots (or those given), in parallel; it yields columns."""
    from pyspark.sql.types import StructType

    spark = g.vertices.sparkSession
    held = spark.sparkContext.broadcast((graph, graph.blocks() if blocks is None else blocks))
    kinds = {f.name: {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()] for f in StructType.fromDDL(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, blocks = held.value
        for batch in batches:
            for columns in function(graph, (blocks[k] for k in batch.column(0).to_pylist())):
                yield pa.record_batch([pa.array(columns[c], kind) for c, kind in kinds.items()], names=list(kinds))

    n = len(held.value[1])
    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, tasks).mapInArrow(run, schema)


@dataclass(frozen=True)
class Walk:
    """A component whose vertices are 0..n-1 from ``lo`` on. A cell is slot * n + vertex, a slot being a root's."""

    lo: int
    n: int
    first: np.ndarray
    dst: np.ndarray
    weight: np.ndarray

    def out(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every arc out of the cells: the cell it leaves, by place, the cell it leads to, its length."""
        v = cells % self.n
        start = self.first[v]
        many = self.first[v + 1] - start
        which = np.repeat(np.arange(len(cells)), many)
        arc = np.arange(len(which)) + (start - np.cumsum(many) + many)[which]
        return which, (cells - v)[which] + self.dst[arc], self.weight[arc]

    def roots(self, a: int, b: int) -> np.ndarray:
        return np.arange(b - a) * self.n + np.arange(a - self.lo, b - self.lo)


def _once(cells: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each cell once."""
    k = np.arange(len(cells))
    scratch[cells] = k
    return cells[scratch[cells] == k]


def levels(w: Walk, a: int, b: int) -> Iterator[np.ndarray]:
    """The cells at distance 0, 1, ... from the roots a..b-1."""
    front = w.roots(a, b)
    seen, scratch = np.zeros((b - a) * w.n, bool), np.zeros((b - a) * w.n, np.int64)
    while len(front):
        seen[front] = True
        yield front
        to = w.out(front)[1]
        front = _once(to[~seen[to]], scratch)


def dependencies(w: Walk, a: int, b: int, weighted: bool = False) -> np.ndarray:
    """How much each vertex lies on shortest paths from the roots a..b-1, summed over roots and targets."""
    roots, cells = w.roots(a, b), (b - a) * w.n
    steps = _tight(w, roots, cells) if weighted else _level_steps(w, roots, cells)
    ways, share = np.zeros(cells), np.zeros(cells)
    ways[roots] = 1.0
    walked = []
    for source, to in steps:
        np.add.at(ways, to, ways[source])
        walked.append((source, to))
    for source, to in reversed(walked):
        np.add.at(share, source, ways[source] / ways[to] * (1 + share[to]))
    share[roots] = 0.0
    return share.reshape(b - a, w.n).sum(0)


def _level_steps(w: Walk, roots: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The arcs of shortest paths, level by level."""
    met, scratch, front = np.zeros(cells, bool), np.zeros(cells, np.int64), roots
    met[roots] = True
    while len(front):
        which, to, _ = w.out(front)
        on = ~met[to]
        source, to = front[which[on]], to[on]
        yield source, to
        front = _once(to, scratch)
        met[front] = True


def _tight(w: Walk, roots: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The arcs of paths of least length (all positive), each step's sources after all steps to them.

    The nearer pending cells are walked from first, so that few are walked from again when a shorter path to
    them turns up. Arcs are noted as they are walked, with the lengths they were walked at; those that still
    hold in the end are the paths'.
    """
    far, scratch, rank = np.full(cells, np.inf), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    far[roots] = 0.0
    span = 2 * w.weight.mean() if len(w.weight) else 0.0
    front, pending, end, step, walked = roots, [], span, 0, []
    while True:
        if not len(front):
            pool = np.concatenate(pending) if pending else roots[:0]
            pool = _once(pool[far[pool] >= end], scratch)
            if not len(pool):
                break
            length = far[pool]
            end = max(length.min() + span, np.nextafter(np.partition(length, len(pool) // 2)[len(pool) // 2], np.inf))
            on = length < end
            front, pending = pool[on], [pool[~on]]
        step += 1
        which, to, length = w.out(front)
        start = far[front]
        reach = start[which] + length
        near = np.flatnonzero(reach <= far[to])
        which, to, reach = which[near], to[near], reach[near]
        walked.append((front[which], to, start[which], reach))
        nearer = reach < far[to]
        to, reach = to[nearer], reach[nearer]
        np.minimum.at(far, to, reach)
        to = _once(to, scratch)
        rank[to] = step
        on = far[to] < end
        front = to[on]
        pending.append(to[~on])
    source, to, start, reach = (np.concatenate(x) for x in zip(*walked))
    on = (reach == far[to]) & (start == far[source]) & (source != to)
    source, to = source[on], to[on]
    # A cell came last in the step that found its length; of paths as long, one may have been found later.
    while len(late := np.flatnonzero(rank[source] >= rank[to])):
        np.maximum.at(rank, to[late], rank[source[late]] + 1)
    by = np.argsort(rank[to], kind="stable")
    source, to = source[by], to[by]
    ends = np.flatnonzero(np.diff(rank[to], append=-1)) + 1
    for i, j in zip([0, *ends.tolist()], ends.tolist()):
        yield source[i:j], to[i:j]


# --- what queries take from them --------------------------------------------------------------

def pairs(g, graph: Numbered) -> DataFrame:
    """``root, id, dist`` of every vertex and what it reaches."""

    def run(graph: Numbered, blocks) -> Iterator[dict]:
        for a, b in blocks:
            w = graph.around(a)
            for depth, cells in enumerate(levels(w, a, b)):
                for k in range(0, len(cells), 100_000):
                    some = cells[k : k + 100_000]
                    yield {"root": graph.ids.take(pa.array(a + some // w.n)), "id": graph.ids.take(pa.array(w.lo + some % w.n)), "dist": np.full(len(some), depth, np.int32)}

    return from_blocks(g, graph, run, "root string, id string, dist int")


def sums(g, graph: Numbered, component: int | None = None) -> DataFrame:
    """``id``, and of the other vertices that reach it: ``r`` their number, ``s`` and ``h`` the sums of distances and of their inverses, ``far`` the greatest; vertices that none reaches are left out.

    Of one component, if given.
    """

    def run(graph: Numbered, blocks) -> Iterator[dict]:
        r, s, far, h = np.zeros(graph.n, np.int64), np.zeros(graph.n, np.int64), np.zeros(graph.n, np.int64), np.zeros(graph.n)
        for a, b in blocks:
            w = graph.around(a)
            own = slice(w.lo, w.lo + w.n)
            for depth, cells in enumerate(levels(w, a, b)):
                if depth:
                    many = np.bincount(cells % w.n, minlength=w.n)
                    r[own] += many
                    s[own] += depth * many
                    h[own] += many / depth
                    far[own] = np.maximum(far[own], np.where(many > 0, depth, 0))
        at = np.flatnonzero(r)
        yield {"id": graph.ids.take(pa.array(at)), "r": r[at], "s": s[at], "h": h[at], "far": far[at]}

    blocks = None if component is None else [x for x in graph.blocks() if graph.comp[x[0]] == component]
    return from_blocks(g, graph, run, "id string, r long, s long, h double, far long", blocks).groupBy("id").agg(F.sum("r").alias("r"), F.sum("s").alias("s"), F.sum("h").alias("h"), F.max("far").alias("far"))


def reach(g, graph: Numbered) -> DataFrame:
    """``id, r``: the number of other vertices reachable from each."""

    def run(graph: Numbered, blocks) -> Iterator[dict]:
        for a, b in blocks:
            w = graph.around(a)
            r = sum(np.bincount(cells // w.n, minlength=b - a) for cells in levels(w, a, b)) - 1
            yield {"id": graph.ids.slice(a, b - a), "r": r}

    return from_blocks(g, graph, run, "id string, r long")


def shares(g, graph: Numbered, weighted: bool = False) -> DataFrame:
    """``id, share``: summed dependencies on each vertex that has any."""
    # Lengths of 0, or lost beside the lengths before them, leave no order of steps: those go root by root.
    plain = weighted and len(graph.weight) > 0 and graph.weight.min() <= 1e-15 * graph.n * abs(graph.weight).max()

    def run(graph: Numbered, blocks) -> Iterator[dict]:
        total, w = np.zeros(graph.n), None
        for a, b in blocks:
            if w is None or not w.lo <= a < w.lo + w.n:
                w = graph.around(a)
            if plain:
                adj = {v: list(zip(w.dst[i:j].tolist(), w.weight[i:j].tolist())) for v, (i, j) in enumerate(zip(w.first.tolist(), w.first[1:].tolist()))}
                for root in range(a - w.lo, b - w.lo):
                    for v, share in kernels.dependencies(root, adj, True).items():
                        total[w.lo + v] += share
            else:
                total[w.lo : w.lo + w.n] += dependencies(w, a, b, weighted)
        at = np.flatnonzero(total)
        yield {"id": graph.ids.take(pa.array(at)), "share": total[at]}

    return from_blocks(g, graph, run, "id string, share double", graph.blocks(min(CELLS, NEAR_CELLS))).groupBy("id").agg(F.sum("share").alias("share"))


def removals(g, graph: Numbered) -> DataFrame:
    """``id, contagion_index``: by how much the largest component of an undirected graph shrinks without each vertex, as a share of all.

    One walk in depth tells of every vertex what falls apart without it, so a component takes its arcs once.
    """
    sizes = graph.sizes()
    start = np.concatenate([[0], np.cumsum(sizes)])
    top = np.sort(sizes)[::-1]
    whole, second, n = int(top[0]), int(top[1]) if len(top) > 1 else 0, graph.n
    several = len(top) > 1 and top[1] == whole

    def run(graph: Numbered, blocks) -> Iterator[dict]:
        for a, b in blocks:
            rest = whole if b - a < whole or several else second
            best = np.maximum(pieces(graph.around(a)), rest)
            yield {"id": graph.ids.slice(a, b - a), "contagion_index": [round((whole - x) / n, 6) for x in best.tolist()]}

    return from_blocks(g, graph, run, "id string, contagion_index double", list(zip(start[:-1].tolist(), start[1:].tolist())))


def pieces(w: Walk) -> np.ndarray:
    """The largest part of a connected undirected component without each of its vertices."""
    first, dst = w.first.tolist(), w.dst.tolist()
    seen, low, size, cut_off, largest, up = [-1] * w.n, [0] * w.n, [1] * w.n, [0] * w.n, [0] * w.n, [-1] * w.n
    at, v, tick = first[:-1], 0, 1
    seen[0] = 0
    while v >= 0:
        if at[v] < first[v + 1]:
            x = dst[at[v]]
            at[v] += 1
            if seen[x] < 0:
                seen[x] = low[x] = tick
                tick += 1
                up[x], v = v, x
            elif x != up[v] and seen[x] < low[v]:
                low[v] = seen[x]
            continue
        p = up[v]
        if p >= 0:
            size[p] += size[v]
            low[p] = min(low[p], low[v])
            if low[v] >= seen[p]:
                cut_off[p] += size[v]
                largest[p] = max(largest[p], size[v])
        v = p
    return np.maximum(largest, w.n - 1 - np.array(cut_off))
