"""Kernels for graphs that fit a task: shortest paths, planarity, communities, robustness, spectra.

Those that work from one vertex at a time get the adjacency in every task and run over vertices in
parallel; those that are sequential by nature run over whole graphs in parallel, one a group. Their
callers check the size first (``MAX_EDGES``, ``MAX_DENSE``) and raise beyond it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Adjacency sent to every task, at most; rows of dense matrices, and cells of a panel, at most.
MAX_EDGES = 2_000_000
MAX_DENSE = 5_000
MAX_CELLS = 50_000_000


def adjacency(arcs: DataFrame, limit: int = MAX_EDGES) -> dict[str, list[tuple[str, float]]]:
    """``src -> [(dst, weight)]``, after checking its size."""
    if arcs.count() > limit:
        raise ValueError(f"more than {limit} arcs; this kernel needs the adjacency in every task")
    out: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for s, d, w in arcs.select("src", "dst", "weight").orderBy("src", "dst").collect():
        out[s].append((d, w))
    return dict(out)


def per_vertex(g, function: Callable[[str, dict], list[tuple]], schema: str) -> DataFrame:
    """Run ``function(vertex, adjacency)`` for every vertex in parallel."""
    spark = g.vertices.sparkSession
    adj = spark.sparkContext.broadcast(adjacency(g.arcs()))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for v in batch["id"] for r in function(v, adj.value)]
            yield pd.DataFrame(rows, columns=names)

    n = max(1, min(g.vertices.count(), spark.sparkContext.defaultParallelism))
    return g.vertices.select("id").repartition(n, "id").mapInPandas(run, schema)


def dependencies(source, adj: dict, weighted: bool = False) -> dict:
    """How much each vertex lies on shortest paths from ``source``, summed over targets."""
    sigma, before, order = defaultdict(float), defaultdict(list), []
    sigma[source] = 1.0
    if not weighted:
        dist, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w, _ in adj.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1 and w != v:
                    sigma[w] += sigma[v]
                    before[w].append(v)
    else:
        done, seen, heap, tick = {}, {source: 0.0}, [(0.0, 0, source)], 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = d
            order.append(v)
            for w, length in adj.get(v, ()):
                if w == v:
                    continue
                far = d + length
                if w not in done and (w not in seen or far < seen[w]):
                    seen[w] = far
                    tick += 1
                    heapq.heappush(heap, (far, tick, w))
                    sigma[w], before[w] = sigma[v], [v]
                elif w not in done and far == seen[w]:
                    sigma[w] += sigma[v]
                    before[w].append(v)
    share = defaultdict(float)
    for w in reversed(order):
        for v in before[w]:
            share[v] += sigma[v] / sigma[w] * (1 + share[w])
    share.pop(source, None)
    return share


def distances(source, adj: dict) -> dict:
    dist, queue = {source: 0}, deque([source])
    while queue:
        v = queue.popleft()
        for w, _ in adj.get(v, ()):
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    return dist


class Union:
    """Disjoint sets with sizes."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.size: dict = {}

    def find(self, v):
        self.up.setdefault(v, v)
        self.size.setdefault(v, 1)
        while self.up[v] != v:
            self.up[v] = self.up[self.up[v]]
            v = self.up[v]
        return v

    def join(self, a, b) -> int:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = (a, b) if self.size[a] >= self.size[b] else (b, a)
            self.up[b] = a
            self.size[a] += self.size[b]
        return self.size[a]


# --- planarity --------------------------------------------------------------------------------

def is_planar(edges: list[tuple], n: int | None = None) -> bool:
    """Path addition on biconnected parts: embed a cycle, then bridge by bridge into admissible faces.

    A bridge that fits no face proves the graph not planar; one that fits a single face goes first.
    """
    graph: dict = defaultdict(set)
    for a, b in edges:
        if a != b:
            graph[a].add(b)
            graph[b].add(a)
    m = sum(map(len, graph.values())) // 2
    if len(graph) >= 3 and m > 3 * len(graph) - 6:
        return False
    return all(_embeds(block) for block in _blocks(graph))


def _blocks(graph: dict) -> list[list[tuple]]:
    """Edge lists of the biconnected components."""
    depth, low, out, stack = {}, {}, [], []
    for root in graph:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        work = [(root, None, iter(graph[root]))]
        while work:
            v, parent, nbrs = work[-1]
            for w in nbrs:
                if w not in depth:
                    depth[w] = low[w] = depth[v] + 1
                    stack.append((v, w))
                    work.append((w, v, iter(graph[w])))
                    break
                if w != parent and depth[w] < depth[v]:
                    stack.append((v, w))
                    low[v] = min(low[v], depth[w])
            else:
                work.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= depth[parent]:
                        block = []
                        while True:
                            e = stack.pop()
                            block.append(e)
                            if e == (parent, v):
                                break
                        out.append(block)
    return out


def _embeds(block: list[tuple]) -> bool:
    graph: dict = defaultdict(set)
    for a, b in block:
        graph[a].add(b)
        graph[b].add(a)
    if len(block) < 9 or len(graph) < 5:
        return True
    if len(block) > 3 * len(graph) - 6:
        return False
    cycle = _cycle(graph)
    placed = set(cycle)
    drawn = {frozenset(e) for e in zip(cycle, cycle[1:] + cycle[:1])}
    faces = [list(cycle), list(cycle)]
    while len(drawn) < len(block):
        choice = None
        for attached, inner, chord in _bridges(graph, placed, drawn):
            fit = [i for i, f in enumerate(faces) if attached <= set(f)]
            if not fit:
                return False
            if choice is None or len(fit) < choice[0]:
                choice = (len(fit), fit[0], attached, inner, chord)
                if len(fit) == 1:
                    break
        _, where, attached, inner, chord = choice
        path = list(chord) if chord else _through(graph, attached, inner)
        placed.update(path)
        drawn.update(frozenset(e) for e in zip(path, path[1:]))
        face = faces.pop(where)
        i, j = face.index(path[0]), face.index(path[-1])
        if i > j:
            i, j, path = j, i, path[::-1]
        faces += [face[:i] + path + face[j + 1 :], face[i : j + 1] + path[-2:0:-1]]
    return True


def _cycle(graph: dict) -> list:
    """Some cycle of a biconnected graph: an edge and a path around it."""
    a = next(iter(graph))
    b = next(iter(graph[a]))
    back, queue = {a: None}, deque([a])
    while queue:
        v = queue.popleft()
        for w in graph[v]:
            if w not in back and not (v == a and w == b):
                back[w] = v
                queue.append(w)
    path = [b]
    while back[path[-1]] is not None:
        path.append(back[path[-1]])
    return path


def _bridges(graph: dict, placed: set, drawn: set) -> Iterator[tuple]:
    """What is not drawn yet: chords between placed vertices, and parts outside with their attachments."""
    for a in placed:
        for b in graph[a]:
            if b in placed and frozenset((a, b)) not in drawn and repr(a) < repr(b):
                yield {a, b}, set(), (a, b)
    seen: set = set()
    for s in graph:
        if s in placed or s in seen:
            continue
        part, attached, queue = {s}, set(), deque([s])
        while queue:
            v = queue.popleft()
            for w in graph[v]:
                if w in placed:
                    attached.add(w)
                elif w not in part:
                    part.add(w)
                    queue.append(w)
        seen |= part
        yield attached, part, None


def _through(graph: dict, attached: set, inner: set) -> list:
    """A path between two attachments through the inside of their part."""
    start = next(iter(attached))
    back, queue = {start: None}, deque([start])
    while queue:
        v = queue.popleft()
        for w in graph[v]:
            if w in inner and w not in back:
                back[w] = v
                queue.append(w)
            elif w in attached and w != start and v != start:
                path = [w, v]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                return path
    raise AssertionError("a part of a biconnected graph has two attachments")


def planar_filter(edges: list[tuple], n: int) -> list[tuple]:
    """Edges (already ascending) kept as long as the graph stays planar, at most 3(n - 2).

    An edge between two components always fits; any other is tested within its own component.
    """
    kept: list[tuple] = []
    sets = Union()
    inside: dict = defaultdict(list)
    for e in edges:
        a, b = sets.find(e[0]), sets.find(e[1])
        if a != b:
            own = inside.pop(a, []) + inside.pop(b, []) + [e[:2]]
            sets.join(a, b)
            inside[sets.find(a)] = own
        elif is_planar([*inside[a], e[:2]]):
            inside[a].append(e[:2])
        else:
            continue
        kept.append(e)
        if len(kept) >= 3 * (n - 2):
            break
    return kept


# --- communities ------------------------------------------------------------------------------

def louvain(edges: list[tuple], vertices: list) -> dict:
    """Deterministic Louvain: vertices in order, moves to the best community, ties to the least."""
    label = {v: i for i, v in enumerate(sorted(vertices))}
    weights: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        i, j = label[a], label[b]
        weights[i][j] += w
        if i != j:
            weights[j][i] += w
    owner = {v: label[v] for v in vertices}
    while True:
        nodes = sorted(set(owner.values()))
        strength = {v: sum(weights[v].values()) + weights[v].get(v, 0.0) for v in nodes}
        total = sum(strength.values())
        if total <= 0:
            break
        comm = {v: v for v in nodes}
        mass = dict(strength)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in nodes:
                links: dict = defaultdict(float)
                for u, w in weights[v].items():
                    if u != v:
                        links[comm[u]] += w
                own = comm[v]
                mass[own] -= strength[v]
                best, gain = own, links[own] - strength[v] * mass[own] / total
                for c in sorted(links):
                    value = links[c] - strength[v] * mass[c] / total
                    if value > gain + 1e-12:
                        best, gain = c, value
                mass[best] += strength[v]
                if best != own:
                    comm[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        owner = {v: comm[c] for v, c in owner.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for i in nodes:
            for j, w in weights[i].items():
                a, b = comm[i], comm[j]
                if a == b:
                    merged[a][a] += w if i == j else w / 2
                else:
                    merged[a][b] += w
        weights = merged
    return _by_size(owner)


def greedy_modularity(edges: list[tuple], vertices: list) -> dict:
    """Merge the pair of communities of largest modularity gain until none is positive.

    Gains wait in a heap; a merge changes those of one community alone, and outdated ones are skipped.
    """
    names = sorted(vertices)
    number = {v: i for i, v in enumerate(names)}
    pairs = {(min(p), max(p)) for p in ((number[e[0]], number[e[1]]) for e in edges) if p[0] != p[1]}
    m = len(pairs)
    near: dict = defaultdict(lambda: defaultdict(float))
    share: dict = defaultdict(float)
    for a, b in sorted(pairs):
        near[a][b] += 1 / (2 * m)
        near[b][a] += 1 / (2 * m)
        share[a] += 1 / (2 * m)
        share[b] += 1 / (2 * m)

    def entry(a: int, b: int) -> tuple[float, int, int]:
        a, b = min(a, b), max(a, b)
        return -2 * (near[a][b] - share[a] * share[b]), -a, -b

    heap = [entry(a, b) for a, b in pairs]
    heapq.heapify(heap)
    members = {i: [v] for i, v in enumerate(names)}
    while heap:
        told = heapq.heappop(heap)
        a, b = -told[1], -told[2]
        if a not in near or b not in near[a] or entry(a, b) != told:
            continue
        if -told[0] <= 1e-15:
            break
        for c, e in near.pop(b).items():
            near[c].pop(b, None)
            if c != a:
                near[a][c] += e
                near[c][a] += e
        near[a].pop(a, None)
        share[a] += share.pop(b)
        members[a] += members.pop(b)
        for c in near[a]:
            heapq.heappush(heap, entry(a, c))
    return _by_size({v: c for c, vs in members.items() for v in vs})


def _by_size(owner: dict) -> dict:
    groups: dict = defaultdict(list)
    for v, c in owner.items():
        groups[c].append(v)
    ranked = sorted(groups.values(), key=lambda vs: (-len(vs), min(vs)))
    return {v: i for i, vs in enumerate(ranked) for v in vs}


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    best, found = None, np.inf
    for _ in range(starts):
        centers = x[[int(rng.integers(len(x)))]]
        while len(centers) < k:
            d = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
            centers = np.vstack([centers, x[rng.choice(len(x), p=p)]])
        for _ in range(100):
            d = ((x[:, None] - centers[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.array([x[own == c].mean(0) if (own == c).any() else centers[c] for c in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        cost = d.min(1).sum()
        if cost < found - 1e-12:
            best, found = own, cost
    return best


def normalised_laplacian(a: np.ndarray) -> np.ndarray:
    d = a.sum(1)
    s = 1 / np.sqrt(d + 1e-9)
    return (np.diag(d) - a) * s[:, None] * s[None, :]
