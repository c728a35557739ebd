"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct ``n``-word shingles. Sizes fall into bands such that two sets
of Jaccard similarity ``num/den`` or more lie in one band or in neighbouring ones. For the pair's
lower band the symmetric difference is at most ``H``, and the universe of shingle hashes is cut into
more than ``H`` segments. A set takes part twice, in its own band and in the band below.

Credits. Looking up a segment's subset finds partners that agree on it (one credit); looking up its
one-deletion neighbourhood too finds those that differ in one element there (two credits). A set that
spends ``H + 1`` credits finds every partner, whatever it leaves out:

* a regular set has more than ``H`` non-empty segments and publishes their subsets;
* a short set has fewer; it publishes the one-deletion neighbourhoods of its segments of two elements
  or more as well, and if even those credits fall short (it is bare), its empty segments.

Whatever a set looks up, its partner has published, or the partner's own look-ups find the pair: a
regular partner needs subsets alone, a short one that isn't bare no empty segments.

Cost-based allocation. Every published signature is counted. What nobody else published costs nothing
and its credit is free; of the rest a set leaves out the most crowded buckets, as many as its credits
allow (the spare segments of a regular set, the spare deletions and empty segments of a short one). A
bucket that no member has chosen is dropped, so a line or passage that many documents share is looked
up only by those that need it.

Equal sets are one node from the start. Every bucket first links its nodes to its least chooser;
candidates are refuted by size and odd sketch, or verified exactly on the shingle sets, which are
stored once. Rounds of forests then join what is left of a bucket's components, and at last members
that stay apart are compared pair by pair, so no link between components is lost, while a group of
near copies costs stars and forests rather than all its pairs. Crowded buckets are cut into blocks
that are compared two by two in separate tasks, and signatures that are frequent within a task are
dealt out by node instead of meeting in one place.

Defined results: a text of fewer than ``n`` words is one shingle, its whole sequence; null, empty and
word-free texts are empty sets, linked with nothing, each its own component; repeated rows are equal
sets and share a component; a null doc_id never is a component's name unless all ids of it are null;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import least_reachable as components
from .storage import discard, few, keyed, materialize, tidied, without
from .text import Words, chunks, grams, mix, signed, string_column

_U = np.uint64

#: Members of a bucket that one task compares with each other; larger buckets are cut into such blocks.
BLOCK = 1_024
#: Nodes of one task with one signature from which on its rows are dealt out by node.
FREQUENT = 64


class Bands:
    """Size bands, their largest symmetric difference and their number of segments."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low, self.most, self.segments = [1], [], []

    def _extend(self) -> None:
        nxt = self.low[-1] * self.den // self.num + 1
        top = nxt - 1
        total = top + top * self.den // self.num
        h = max(t - 2 * -(-self.num * t // (self.num + self.den)) for t in range(max(2, total - 4), total + 1))
        self.low.append(nxt)
        self.most.append(max(0, h))
        # Spare segments for the empty ones of the band's smallest sets, and two deviations more.
        empty = (h + 1) * math.exp(-self.low[-2] / max(1, h + 1))
        self.segments.append(0 if h <= 0 else h + 1 + max(1, math.ceil(empty + 2 * math.sqrt(empty))))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.low[-1] <= int(sizes.max(initial=0)):
            self._extend()
        return np.searchsorted(self.low, sizes, side="right") - 1


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their bounds."""
    words = Words(texts, lower=True)
    h = words.hashes()
    g = grams(h, n)
    out, sizes = [], np.zeros(len(words.counts), dtype=np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b - a >= n:
            one = np.unique(g[a : b - n + 1])
        elif b > a:
            one = mix(grams(h[a:b], b - a) + _U(b - a))
        else:
            continue
        out.append(one)
        sizes[i] = len(one)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def set_hashes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; those of empty sets mean nothing."""
    out = []
    for salt in (1, 2):
        run = np.concatenate(([_U(0)], np.cumsum(mix(values + _U(salt)), dtype=np.uint64)))
        out.append(mix(run[bounds[1:]] - run[bounds[:-1]]))
    return out[0], out[1]


#: Words of an odd sketch: bit b tells whether an odd number of a set's hashes fall into cell b. Two
#: sketches differ in no more bits than the sets in elements, so they refute candidates exactly.
SKETCH = tuple(f"k{i}" for i in range(8))
_CELLS = 64 * len(SKETCH)


def odd_sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of 64-bit words a set."""
    n = len(bounds) - 1
    cell = np.repeat(np.arange(n), np.diff(bounds)) * _CELLS + ((values >> _U(11)) & _U(_CELLS - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * _CELLS) & 1).astype(np.uint8).reshape(n, _CELLS)
    return np.packbits(odd, axis=1).view(np.int64)


def most_apart(na: str, nb: str, num: int, den: int) -> str:
    """SQL: the largest symmetric difference of linked sets of these sizes."""
    return f"({na} + {nb} - 2 * ((({num} * ({na} + {nb})) + {num + den - 1}) div {num + den}))"


class Segments:
    """The segments of the sets of a chunk, in their own bands (``below`` 0) or in the bands below (1)."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, bands: Bands, below: int) -> None:
        size = np.diff(bounds)
        self.n = len(size)
        band = bands.of(size) - below
        while len(bands.most) <= band.max(initial=0):
            bands._extend()
        most, segments = np.array(bands.most), np.array(bands.segments)
        used = (size > 0) & (band >= 0)
        used[used] = segments[band[used]] > 0
        self.band = np.maximum(band, 0)
        self.m, self.h = np.where(used, segments[self.band], 0), np.where(used, most[self.band], 0)
        self.doc = np.repeat(np.arange(self.n), np.where(used, size, 0))
        self.element = np.flatnonzero(np.repeat(used, size))
        self.segment = (((values[self.element] >> _U(32)) * self.m[self.doc].astype(np.uint64)) >> _U(32)).astype(np.int64)
        cell = (np.cumsum(self.m) - self.m)[self.doc] + self.segment
        self.first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, dtype=np.int64)
        self.owner = self.doc[self.first]
        self.count = np.diff(np.append(self.first, len(cell)))
        self.filled = np.bincount(self.owner, minlength=self.n)
        self.twos = np.bincount(self.owner[self.count > 1], minlength=self.n)
        self.short = used & (self.filled <= self.h)
        self.bare = self.short & (self.filled + self.twos <= self.h)

    def spare(self) -> tuple[np.ndarray, np.ndarray]:
        """How many subsets, and how many deletions or empty segments, each set may leave out."""
        regular = (self.m > 0) & ~self.short
        more = self.twos + np.where(self.bare, self.m - self.filled, 0)
        return np.where(regular, self.filled - self.h - 1, 0), np.where(self.short, more - (self.h + 1 - self.filled), 0)

    def place(self, owner: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return mix((segment.astype(np.uint64) << _U(16)) + self.band[owner].astype(np.uint64) + _U(1))


def signatures(values: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the set each belongs to, and its part.

    ``part``: lowest bit, the band (0 own, 1 below); the rest 0 for a subset, ``1 + segment`` for a
    deletion in it, ``-1 - segment`` for an empty segment.
    """
    inner = mix(values + _U(7))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for below in (0, 1):
        s = Segments(values, bounds, bands, below)
        if not len(s.element):
            continue
        content = np.add.reduceat(inner[s.element], s.first)
        place = s.place(s.owner, s.segment[s.first])
        out.append((mix(content ^ place), s.owner, np.full(len(content), below)))
        if s.short.any():
            which = np.repeat(np.arange(len(s.first)), s.count)
            cut = (s.count[which] > 1) & s.short[s.doc]
            out.append((mix((content[which[cut]] - inner[s.element[cut]]) ^ place[which[cut]]), s.doc[cut], below + 2 * (1 + s.segment[cut])))
            for d in np.flatnonzero(s.bare):
                empty = np.setdiff1d(np.arange(s.m[d]), s.segment[s.doc == d])
                owner = np.full(len(empty), d)
                out.append((mix(s.place(owner, empty)), owner, below - 2 * (1 + empty)))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


_SETS = "__key long, doc_id long, size long, node long, twin long, subsets0 int, more0 int, subsets1 int, more1 int, " + ", ".join(f"{k} long" for k in SKETCH)


def _sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row a document: its set's size, hashes, sketch, and how much it may leave out of either band."""
    names = [c.split()[0] for c in _SETS.split(", ")]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            texts = string_column(batch, "text")
            for lo, hi in chunks(texts):
                values, bounds = shingle_sets(texts.slice(lo, hi - lo), n)
                one, two = set_hashes(values, bounds)
                size = np.diff(bounds)
                empty = size == 0
                sketch = odd_sketches(values, bounds)
                spare = [x.astype(np.int32) for below in (0, 1) for x in Segments(values, bounds, bands, below).spare()]
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size), pa.array(signed(one), mask=empty), pa.array(signed(two), mask=empty), *map(pa.array, spare)]
                yield pa.record_batch([*columns, *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]], names=names)

    return docs.select("__key", "doc_id", "text").mapInArrow(run, _SETS)


def _published(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``slot, node, part, own``: signatures of each task's distinct sets, to be grouped by slot.

    The slot is the signature, and ``own`` null. Of a signature that is frequent within a task one row
    stands for all (``own`` tells so), the others, known to be shared, have a slot of their own.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            sig, node, part = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(sig, kind="stable")
            sig, node, part = sig[order], node[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            hot = np.repeat(size >= FREQUENT, size)
            lead = np.zeros(len(sig), dtype=bool)
            lead[first] = True
            slot = np.where(hot & ~lead, mix(sig ^ mix(node)), sig)
            for a in range(0, len(sig), 100_000):
                z = slice(a, a + 100_000)
                yield pa.record_batch([pa.array(signed(slot[z])), pa.array(signed(node[z])), pa.array(part[z].astype(np.int32)), pa.array(signed(sig[z]), mask=~hot[z])], names=["slot", "node", "part", "own"])

        for batch in batches:
            texts = string_column(batch, "text")
            for lo, hi in chunks(texts):
                values, bounds = shingle_sets(texts.slice(lo, hi - lo), n)
                node, twin = set_hashes(values, bounds)
                sig, owner, part = signatures(values, bounds, bands)
                fresh = np.zeros(len(node), dtype=bool)
                for i, v in enumerate(zip(node.tolist(), twin.tolist())):
                    if v not in seen:
                        seen.add(v)
                        fresh[i] = True
                keep = fresh[owner]
                if keep.any():
                    held.append((sig[keep], node[owner[keep]], part[keep]))
                if sum(len(h[0]) for h in held) > 400_000:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "slot long, node long, part int, own long")


def _shared(published: DataFrame) -> DataFrame:
    """``sig, node, part`` of signatures that several nodes published."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the only row so far of the running slot
        several = last = None  # the running slot if it had several rows, and the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, node, part = (batch.column(i).to_numpy() for i in range(3))
            own, known = batch.column(3).fill_null(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            fresh = np.concatenate(([(slot[0], node[0]) != last], (slot[1:] != slot[:-1]) | (node[1:] != node[:-1])))
            last = (slot[-1], node[-1])
            rows = [x[fresh] for x in (slot, node, part, own, known)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            slot, node, part, own, known = rows
            if not len(slot):
                continue
            first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            size = np.diff(np.append(first, len(slot)))
            many = size > 1
            many[0] |= several is not None and slot[0] == several
            many |= np.logical_or.reduceat(known, first)
            keep = np.repeat(many, size)
            held, several = (None, slot[-1]) if many[-1] else ([x[-1:] for x in rows], None)
            if keep.any():
                yield pa.record_batch([pa.array(np.where(known, own, slot)[keep]), pa.array(node[keep]), pa.array(part[keep])], names=["sig", "node", "part"])

    return published.repartition("slot").sortWithinPartitions("slot", "node").mapInArrow(run, "sig long, node long, part int")


def _chosen(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """``sig, center, node, chosen``: buckets that a member has chosen, each row beside the least chooser."""
    counts = materialize(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "join-counts")
    spare = reps.groupBy("node").agg(*[F.min(c).alias(c) for c in ("subsets0", "more0", "subsets1", "more1")])
    more, below = F.shiftright("part", 1) != 0, F.col("part").bitwiseAND(F.lit(1))
    rows = shared.join(few(counts), "sig").withColumns({"more": more, "below": below}).withColumn("option", F.when(more, F.col("part").cast("long")).otherwise(F.col("sig")))
    rows = rows.repartition("node").withColumn("cost", F.sum("n").over(Window.partitionBy("node", "below", "more", "option")))
    place = F.dense_rank().over(Window.partitionBy("node", "below", "more").orderBy(F.col("cost").desc(), "option"))
    rows = rows.withColumn("place", place).join(spare, "node")
    may = F.when(F.col("more"), F.when(F.col("below") == 0, F.col("more0")).otherwise(F.col("more1"))).otherwise(F.when(F.col("below") == 0, F.col("subsets0")).otherwise(F.col("subsets1")))
    members = materialize(rows.select("sig", "node", (F.col("place") > may).alias("chosen")), "join-members")
    buckets = members.groupBy("sig").agg(F.min(F.when(F.col("chosen"), F.col("node"))).alias("center"), F.count(F.lit(1)).alias("n")).where("center is not null and n > 1")
    buckets = materialize(buckets, "join-centers")
    out = materialize(members.join(few(buckets), "sig").select("sig", "n", "center", "node", "chosen"), "join-buckets")
    discard(counts, members, buckets)
    return out


def _stored(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``__key, set`` of the documents with these keys."""

    @tidied
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "text")
            for lo, hi in chunks(texts):
                values, bounds = shingle_sets(texts.slice(lo, hi - lo), n)
                packed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(values)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), packed], names=["__key", "set"])

    keys = materialize(keys.select("__key").distinct(), "join-keys")
    out = materialize(docs.select("__key", "text").join(few(keys), "__key", "left_semi").mapInArrow(sets, "__key long, set array<long>"), "join-sets")
    discard(keys)
    return out


def _verified(pairs: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """Of written key pairs ``a, b`` those whose sets are similar enough, written."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("__key")).distinct(), "join-keys")
    own = stored.join(few(needed), "__key", "left_semi")
    both = pairs.join(own.select(F.col("__key").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("__key").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("all"))
    out = materialize(both.where(F.lit(den) * F.col("both") >= F.lit(num) * (F.col("all") - F.col("both"))).select("a", "b"), "join-edges")
    discard(needed)
    return out


def _across(members: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs ``a, b`` of bucket members of different components that size and sketch don't refute.

    ``members``: sig, n, comp, rep, size, chosen and the sketch. One of a pair must have chosen the
    bucket. Refuted pairs never leave the task. ``forest`` gives only as many pairs of a block as would
    join its components if all of them held.
    """

    def pairs(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        comp, rep, size, chosen, sketch = (np.concatenate(x) for x in zip(*rows))
        a, b = [], []
        for i in range(len(rep) - 1):
            other = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if not chosen[i]:
                other = other[chosen[other]]
            if not len(other):
                continue
            both = size[other] + size[i]
            apart = both - 2 * -(-num * both // (num + den))
            other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1) <= apart]
            if forest and len(other):
                found, where = np.unique(comp[other], return_index=True)
                other = other[where]
                comp[np.isin(comp, found)] = comp[i]
            a.append(np.full(len(other), rep[i]))
            b.append(rep[other])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current, sent = None, set()

        def flush():
            a, b = pairs(held) if sum(len(h[1]) for h in held) > 1 else ((), ())
            new = [p for p in dict.fromkeys(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) if p not in sent] if len(a) else []
            if new:
                if len(sent) > 100_000:
                    sent.clear()
                sent.update(new)
                yield pa.record_batch([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, comp, rep, size = (batch.column(i).to_numpy() for i in range(4))
            chosen = batch.column(4).to_numpy(zero_copy_only=False)
            sketch = np.stack([batch.column(5 + i).to_numpy() for i in range(len(SKETCH))], axis=1).view(np.uint64)
            cut = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            for lo, hi in zip(cut[:-1], cut[1:]):
                if cell[lo] != current:
                    yield from flush()
                    held, current = [], cell[lo]
                held.append((comp[lo:hi], rep[lo:hi], size[lo:hi], chosen[lo:hi], sketch[lo:hi]))
        yield from flush()

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    split = members.withColumn("blocks", blocks).withColumn("block", own)
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    split = split.withColumn("other", F.explode(other)).withColumn("cell", F.when(F.col("blocks") == 1, F.col("sig")).otherwise(F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))))
    ordered = split.select("cell", "comp", "rep", "size", "chosen", *SKETCH).repartition("cell").sortWithinPartitions("cell", "rep")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _placed(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of keyed documents, one row each with size and set hashes; and of each set the least row of its component.

    The second: ``node, twin, kept`` with ``kept`` a struct of (no id, doc_id, __key).
    """
    sets = materialize(_sets(docs, n, num, den), "join-nodes")
    # A node is a set hash; a representative is the least row of a set (two sets with one hash differ in ``twin``).
    numbers = ["size", "subsets0", "more0", "subsets1", "more1", *SKETCH]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("least")
    reps = materialize(sets.where("size > 0").groupBy("node", "twin").agg(F.min("__key").alias("rep"), least, *[F.max(k).alias(k) for k in numbers]), "join-reps")
    shared = materialize(_shared(_published(docs, n, num, den)), "join-shared")
    members = _chosen(shared, reps)
    discard(shared)

    # Two sets with one hash are a candidate pair of their own.
    twins = reps.alias("x").join(reps.alias("y"), F.expr("x.node = y.node and x.twin < y.twin")).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    twins = materialize(twins, "join-twins")
    keys = reps.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("__key")).unionByName(twins.select(F.explode(F.array("a", "b")).alias("__key")))
    stored = _stored(docs, keys, n)

    def by_rep(pairs: DataFrame) -> DataFrame:
        """Node pairs to pairs of representatives that neither size nor sketch refutes."""
        left = reps.select(F.col("node").alias("center"), F.col("rep").alias("a"), F.col("size").alias("na"), *[F.col(k).alias(f"a{k}") for k in SKETCH])
        right = reps.select("node", F.col("rep").alias("b"), F.col("size").alias("nb"), *[F.col(k).alias(f"b{k}") for k in SKETCH])
        apart = " + ".join(f"bit_count(a{k} ^ b{k})" for k in SKETCH)
        p = pairs.join(left, "center").join(right, "node").where(f"a <> b and {apart} <= {most_apart('na', 'nb', num, den)}")
        return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tried = materialize(by_rep(members.where("center <> node").select("center", "node").distinct()).unionByName(twins).distinct(), "join-tried")
    edges = _verified(tried, stored, num, den)
    labels = components(edges)

    # What the stars left open: pairs of one bucket in different components.
    forest, states = True, [tried, edges]
    while True:
        named = materialize(reps.join(labels, reps["rep"] == labels["v"], "left").select("node", "rep", "size", F.coalesce("label", "rep").alias("comp"), *SKETCH), "join-named")
        mixed = materialize(members.join(named.select("node", "comp"), "node").groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig"), "join-mixed")
        rest = _across(members.join(few(mixed), "sig", "left_semi").join(named, "node"), num, den, forest)
        rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "join-rest")
        discard(named, mixed)
        states.append(rest)
        if rest.isEmpty() and forest:
            forest = False  # what refuted or failed pairs have hidden from the forests
            continue
        if rest.isEmpty():
            break
        more = _verified(rest, stored, num, den)
        states.append(more)
        tried = tried.unionByName(rest)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            discard(labels)
            labels = components(edges)
        if not forest:
            break

    best = materialize(labels.join(reps, labels["v"] == reps["rep"]).groupBy("label").agg(F.min("least").alias("best")), "join-best")
    found = materialize(labels.join(few(best), "label").select("v", "best"), "join-found")
    placed = materialize(reps.join(found, reps["rep"] == found["v"], "left").select("node", "twin", F.coalesce("best", "least").alias("kept")), "join-placed")
    discard(members, stored, twins, labels, best, found, reps, *states)
    return sets.select("__key", "doc_id", "size", "node", "twin"), placed


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs, _ = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "join-docs")
    sets, placed = _placed(docs, n, num, den)
    out = sets.join(placed, ["node", "twin"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("kept").isNotNull(), F.col("kept.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component the row of least id, or one of them where rows share it; no id counts as the greatest.

    Documents with no words are not linked with anything and all stay.
    """
    keys, _ = keyed(docs, "join-docs")
    sets, placed = _placed(keys.select("__key", F.col("doc_id").cast("long").alias("doc_id"), "text"), n, num, den)
    drop = sets.join(placed, ["node", "twin"]).where("__key <> kept.__key").select("__key")
    return without(keys, drop, "__key", "join-drop").select(*docs.columns)


def oracle_sql(n: int = 4, num: int = 85, den: int = 100) -> str:
    """All pairs that share a shingle, their links, and what each document reaches."""
    return rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) end as g from d),
e as materialized (select doc_id, len(g) as n, unnest(g) as h from s),
shared as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select x, y from shared where {den} * c >= {num} * (nx + ny - c)),
ways as materialized (select x, y from links union all select y, x from links),
reach as (select doc_id as root, doc_id as id from s union select r.root, w.y from reach r join ways w on w.x = r.id)
select s.doc_id, len(s.g)::bigint as n_shingles, min(r.id) as component_id from s join reach r on r.root = s.doc_id group by 1, 2
"""


ORACLE_SQL = oracle_sql()
