"""Substring deduplication by relative Lempel-Ziv parsing against an index of the whole corpus.

A document is parsed into factors, each a pointer to another place with the same words; factors of at
least ``WINDOW`` words are duplicate spans, and the words they cover go. Every block of the corpus is a
reference block:

1. Index. Every window of ``WINDOW`` words selects the least hash among its ``ANCHOR``-word grams, its
   anchor; the windows of one document with one anchor place are a block. Equal windows select equal
   anchors, so a window can only recur if its anchor does. Blocks are grouped by anchor and content: a
   block that recurs whole refers to the place of its content before it, windows and all. If an anchor
   has blocks of several contents, the first of each content has its windows hashed whole, and a window
   refers to the place of its hash before it. The first place of all refers to the second.
2. Alignments. The references of a run of windows give a document its candidate alignments: a reference
   text and a shift. Where none of them accounts for the whole run, each is extended word by word in the
   reference text, as far as it goes.
3. Parsing. A factor starts at the first window that is not covered and takes the alignment that reaches
   furthest (ties: the least place). At its end the windows across the boundary are tested: the first of
   them that recurs starts the next factor, which may overlap the words before. So factors are the
   fewest that cover the run along candidate alignments.

Windows are judged on the input, and exactly (up to 96-bit hashes), however often they occur. Contents
that are frequent within a task are settled there: one row stands for them in the common group, the
others refer to their neighbours from slots of their own, so no group gathers a passage that a third
of the documents share. A place never refers to itself.

Defined results: a null text has no words; a document of fewer than ``WINDOW`` words keeps them all; a
repetition within a document counts, overlapping ones too; repeated rows are separate documents with
the same words, whatever their ids; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keyed, materialize, tidied
from .text import Words, _Powers, chunks, long_grams, mix, signed, string_column

WINDOW = 35
ANCHOR = 10
#: Places of one content (or one anchor) within a task from which on they are dealt out instead of grouped.
FREQUENT = 64
_HELD = 200_000
_U = np.uint64


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value among ``width`` from each position on; the leftmost of equals."""
    at = np.arange(len(h))
    span = 1
    while 2 * span <= width:
        left, right = at[:-span], at[span:]
        at = np.where(h[left] <= h[right], left, right)
        span *= 2
    if span < width:
        shift = width - span
        left, right = at[:-shift], at[shift:]
        at = np.where(h[left] <= h[right], left, right)
    return at


def windows(texts: pa.Array, window: int, anchor: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and of each window: its first word, its anchor's place and its anchor's hash."""
    words = Words(texts)
    h = words.hashes()
    if len(h) < window:
        none = np.empty(0, dtype=np.int64)
        return words, h, none, none, np.empty(0, dtype=np.uint64)
    grams = long_grams(h, anchor)
    place = sliding_least(grams, window - anchor + 1)
    doc = words.doc_of_word()
    start = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
    return words, h, start, place[start], grams[place[start]]


class Blocks:
    """The blocks of a chunk of texts: runs of windows of one document with one anchor place."""

    def __init__(self, texts: pa.Array, window: int, anchor: int) -> None:
        words, h, start, place, value = windows(texts, window, anchor)
        self.words, self.window, self.h, self.start = words, window, h, start
        owner = np.searchsorted(words.first, start, side="right") - 1
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))) if len(start) else np.empty(0, dtype=bool)
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(start)))
        self.owner = owner[self.begin]
        self.anchor = signed(value[self.begin])
        self.at = start[self.begin] - words.first[self.owner]
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def content(self) -> np.ndarray:
        """A hash of the words under all windows of a block."""
        up, down = _Powers.get(len(self.h) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.h + np.uint64(9)) * up[: len(self.h)], dtype=np.uint64)))
        first = self.start[self.begin]
        end = first + self.size + self.window - 1
        return signed(mix((run[end] - run[first]) * down[first] + self.size.astype(np.uint64)))


# --- index ------------------------------------------------------------------------------------

_PLACES = "slot long, content long, __key long, at int, state int, ref_key long, ref_at int"
_PLAIN, _OPEN, _NOTICE = 0, 1, 2


def dealt(slot: np.ndarray, content: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Places of a task, to be grouped by slot and content; what is frequent here leaves its group.

    Of a frequent content the first place stands for all; the others refer each to the one before. The
    other places of a frequent slot are open, and a notice tells their group of them.
    """
    order = np.lexsort((at, key, content, slot))
    slot, content, key, at = slot[order], content[order], key[order], at[order]
    n = len(slot)
    new = np.concatenate(([True], (slot[1:] != slot[:-1]) | (content[1:] != content[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    hot = np.repeat(size >= FREQUENT, size)
    own = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    other = np.add.reduceat((~hot).astype(np.int64), own)
    crowd = np.repeat(other >= FREQUENT, np.diff(np.append(own, n))) & ~hot
    ref = np.where(new, np.minimum(np.arange(n) + 1, n - 1), np.arange(n) - 1)
    away = (hot & ~new) | crowd
    spread = np.where(away, signed(mix(slot.view(np.uint64) ^ mix(key.view(np.uint64) + _U(1)) ^ mix(at.astype(np.uint64) + _U(2)))), slot)
    told = slot[own[other >= FREQUENT]]
    none = np.zeros(len(told), dtype=np.int64)
    columns = [
        pa.array(np.concatenate([spread, told])),
        pa.array(np.concatenate([content, signed(mix(told.view(np.uint64) + _U(3)))])),
        pa.array(np.concatenate([key, none])),
        pa.array(np.concatenate([at, none]).astype(np.int32)),
        pa.array(np.concatenate([np.where(crowd, _OPEN, _PLAIN), none + _NOTICE]).astype(np.int32)),
        pa.array(np.concatenate([key[ref], none]), mask=np.concatenate([~hot, none == 0])),
        pa.array(np.concatenate([at[ref], none]).astype(np.int32), mask=np.concatenate([~hot, none == 0])),
    ]
    return pa.record_batch(columns, names=[c.split()[0] for c in _PLACES.split(", ")])


class _Dealer:
    """Gathers places and deals them out some hundred thousand at a time."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])
        if self.size > _HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield dealt(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.size = [], 0


def _referred(places: DataFrame) -> DataFrame:
    """``__key, at, hashed, ref_key, ref_at``: the place of the same content before each, the second for the first.

    ``hashed``: its slot has other contents, and it is the first of its own.
    """
    places = places.repartition("slot")
    same = Window.partitionBy("slot", "content").orderBy("__key", "at")
    here = F.struct("__key", "at")
    rows = places.withColumns({"number": F.row_number().over(same), "before": F.lag(here).over(same), "second": F.lead(here).over(same)})
    alike = Window.partitionBy("slot")
    rows = rows.withColumn("several", F.min("content").over(alike) != F.max("content").over(alike)).where(F.col("state") != _NOTICE)
    given = F.when(F.col("ref_key").isNotNull(), F.struct(F.col("ref_key").alias("__key"), F.col("ref_at").alias("at")))
    rows = rows.withColumn("ref", F.coalesce("before", given, "second"))
    hashed = (F.col("state") == _OPEN) | (F.col("several") & (F.col("number") == 1))
    rows = rows.select("__key", "at", hashed.alias("hashed"), F.col("ref.__key").alias("ref_key"), F.col("ref.at").alias("ref_at"))
    return rows.where("hashed or ref_key is not null")


def _blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer()
        for batch in batches:
            texts, keys = string_column(batch, "text"), batch.column(0).to_numpy()
            for lo, hi in chunks(texts):
                b = Blocks(texts.slice(lo, hi - lo), window, anchor)
                if len(b.begin):
                    yield from dealer.add(b.anchor, b.content(), keys[lo + b.owner], b.at)
        yield from dealer.rest()

    return docs.select("__key", "text").mapInArrow(run, _PLACES)


def _marked(b: Blocks, k: int, marks: pa.ListScalar) -> tuple[np.ndarray, list[np.ndarray]]:
    """Blocks of document ``k`` that are marked, and the marks' other columns in that order."""
    if not marks.is_valid:
        return np.empty(0, dtype=np.int64), [np.empty(0, dtype=np.int64)] * 4
    lo, hi = b.bounds[k], b.bounds[k + 1]
    at = marks.values.field(0).to_numpy()
    block = lo + np.searchsorted(b.at[lo:hi], at)
    ref = marks.values.field(2)
    return block, [marks.values.field(1).to_numpy(zero_copy_only=False), ref.is_valid().to_numpy(zero_copy_only=False), ref.fill_null(0).to_numpy(), marks.values.field(3).fill_null(0).to_numpy()]


def _inside(b: Blocks, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the blocks each of their windows is in, and its place there."""
    n = b.size[block]
    return np.repeat(np.arange(len(block)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _windows(told: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows of blocks that must be hashed whole."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer()
        for batch in batches:
            keys, texts, marks = batch.column(0).to_numpy(), batch.column(1).cast(pa.string()), batch.column(2)
            for lo, hi in chunks(texts):
                b, chosen = Blocks(texts.slice(lo, hi - lo), window, anchor), []
                for k in range(hi - lo):
                    block, (hashed, *_) = _marked(b, k, marks[lo + k])
                    if len(block):
                        chosen.append(block[hashed.astype(bool)])
                block = np.concatenate(chosen) if chosen else np.empty(0, dtype=np.int64)
                if len(block):
                    which, inside = _inside(b, block)
                    start = b.start[b.begin[block]][which] + inside
                    first, second = long_grams(b.h, window, 3)[start], long_grams(b.h, window, 5)[start]
                    yield from dealer.add(signed(first), (second >> _U(33)).astype(np.int64), keys[lo + b.owner[block]][which], b.at[block][which] + inside)
        yield from dealer.rest()

    return told.select("__key", "text", "marks").mapInArrow(run, _PLACES)


# --- parsing ----------------------------------------------------------------------------------

class Alignments:
    """A document's windows with references: their runs, and the alignments of each run."""

    def __init__(self, at: np.ndarray, ref_key: np.ndarray, ref_at: np.ndarray) -> None:
        rows = np.unique(np.stack([at, ref_key, ref_at - at]).astype(np.int64), axis=1)  # by window, key, shift
        at, key, shift = rows
        there = np.unique(at)
        cut = np.flatnonzero(np.diff(there) != 1)
        self.first, self.last = there[np.concatenate(([0], cut + 1))], there[np.concatenate((cut, [len(there) - 1]))]
        run = np.searchsorted(self.first, at, side="right") - 1
        kinds, counts = np.unique(np.stack([run, key, shift]), axis=1, return_counts=True)
        self.run, self.key, self.shift = kinds
        self.whole = counts == (self.last - self.first + 1)[self.run]

    def contested(self) -> np.ndarray:
        """Alignments of runs that none of them accounts for whole."""
        settled = np.zeros(len(self.first), dtype=bool)
        settled[self.run[self.whole]] = True
        return np.flatnonzero(~settled[self.run])

    def factors(self, window: int, stretches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """``(start, words, ref_key, ref_start)``; ``stretches``: (window, windows, key, place) of contested alignments."""
        out, settled = [], set()
        for i in np.flatnonzero(self.whole).tolist():  # in order of run, key, shift: the least comes first
            r = int(self.run[i])
            if r not in settled:
                settled.add(r)
                a, z = int(self.first[r]), int(self.last[r])
                out.append((a, z - a + window, int(self.key[i]), a + int(self.shift[i])))
        for r in range(len(self.first)):
            if r not in settled:
                out += greedy(int(self.first[r]), int(self.last[r]), window, [s for s in stretches if self.first[r] <= s[0] <= self.last[r]])
        return sorted(out)


def greedy(first: int, last: int, window: int, stretches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Factors of the run of windows ``first..last``: from each start the stretch that reaches furthest."""
    out, pos, k = [], first, 0
    stretches = sorted(stretches)
    open_: list[tuple[int, int, int, int]] = []
    while pos <= last:
        while k < len(stretches) and stretches[k][0] <= pos:
            open_.append(stretches[k])
            k += 1
        open_ = [s for s in open_ if s[0] + s[1] > pos]
        end, _, key, at = min((-(s[0] + s[1]), s[2], s[2], s[3] + pos - s[0]) for s in open_)
        out.append((pos, -end - pos + window - 1, key, at))
        pos = -end
    return out


def _aligned(b: Blocks, k: int, marks: pa.ListScalar, found: pa.ListScalar) -> Alignments | None:
    block, (_, closed, key, at) = _marked(b, k, marks)
    parts = []
    if closed.any():
        closed = closed.astype(bool)
        block, key, at = block[closed], key[closed], at[closed]
        which, inside = _inside(b, block)
        parts.append((b.at[block][which] + inside, key[which], at[which] + inside))
    if found.is_valid:
        parts.append(tuple(found.values.field(i).to_numpy() for i in range(3)))
    return Alignments(*(np.concatenate(x) for x in zip(*parts))) if parts else None


def _short_hashes(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)).astype(np.uint32)


def _questions(told: DataFrame, window: int, anchor: int) -> DataFrame:
    """``ref_key, asker, first, shift, words``: alignments of contested runs, to be extended in the reference."""

    def questions(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["ref_key", "asker", "first", "shift", "words"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, marks, found = batch.column(0).to_numpy(), batch.column(1).cast(pa.string()), batch.column(2), batch.column(3)
            for lo, hi in chunks(texts):
                b, rows, held = Blocks(texts.slice(lo, hi - lo), window, anchor), [], 0
                for k in range(hi - lo):
                    a = _aligned(b, k, marks[lo + k], found[lo + k])
                    if a is None:
                        continue
                    begin = int(b.words.first[k])
                    for i in a.contested().tolist():
                        r = int(a.run[i])
                        first, last = int(a.first[r]), int(a.last[r])
                        rows.append((int(a.key[i]), int(keys[lo + k]), first, int(a.shift[i]), _short_hashes(b.h[begin + first : begin + last + window]).tobytes()))
                        held += len(rows[-1][-1])
                        if held > 4_000_000:
                            yield questions(rows)
                            rows, held = [], 0
                if rows:
                    yield questions(rows)

    return told.select("__key", "text", "marks", "found").mapInArrow(run, "ref_key long, asker long, first int, shift long, words binary")


def _answers(asked: DataFrame, window: int) -> DataFrame:
    """``__key, at, n, ref_key, ref_at``: stretches of ``n`` windows that an alignment accounts for."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, np.empty(0, dtype=np.uint32)
        for batch in batches:
            refs, askers, firsts, shifts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            texts, words, rows = batch.column(1).cast(pa.string()), batch.column(5), []
            for i, ref in enumerate(refs):
                if ref != last:
                    last, h = ref, _short_hashes(Words(texts.slice(i, 1)).hashes())
                own = np.frombuffer(words[i].as_buffer(), dtype=np.uint32)
                begin = firsts[i] + shifts[i]
                lo, hi = max(0, -begin), min(len(own), len(h) - begin)
                same = np.zeros(len(own) + 2, dtype=np.int8)
                if hi > lo:
                    same[1 + lo : 1 + hi] = own[lo:hi] == h[begin + lo : begin + hi]
                edge = np.flatnonzero(np.diff(same))
                for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if z - a >= window:
                        rows.append((askers[i], firsts[i] + a, z - a - window + 1, ref, begin + a))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["__key", "at", "n", "ref_key", "ref_at"])

    return asked.select("ref_key", "text", "asker", "first", "shift", "words").mapInArrow(run, "__key long, at int, n int, ref_key long, ref_at long")


def _factored(docs: DataFrame, window: int, anchor: int, schema: str, rows_of) -> DataFrame:
    """Parse every document; ``rows_of(doc_id, words, factors)`` makes the result's rows."""
    docs, own = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "substring")
    marks = _referred(_blocks(docs, window, anchor))
    marks = materialize(marks.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "hashed", "ref_key", "ref_at"))).alias("marks")), "substring-marks")
    # One exchange of the texts serves all that follows: all ask for the same two columns, and for keys
    # that are not null, as an inner join would (none is).
    texts = docs.select("__key", "text").where("__key is not null")
    told = texts.join(marks, "__key", "left")
    found = _referred(_windows(told, window, anchor)).where("ref_key is not null")
    found = found.groupBy("__key").agg(F.collect_list(F.struct("at", "ref_key", "ref_at")).alias("found"))
    told = told.join(found, "__key", "left")
    asked = texts.join(_questions(told, window, anchor), F.col("__key") == F.col("ref_key"))
    stretches = _answers(asked, window).groupBy("__key").agg(F.collect_list(F.struct("at", "n", "ref_key", "ref_at")).alias("stretches"))
    told = told.join(stretches, "__key", "left")
    told = told.withColumn("doc_id", F.col("__key")) if own else told.join(docs.select("__key", "doc_id"), "__key")
    told = told.select("doc_id", "text", "marks", "found", "stretches")
    out = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in schema.split(", ")])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.string())
            marks, found, stretches = (batch.column(i) for i in (2, 3, 4))
            for lo, hi in chunks(texts):
                b, rows = Blocks(texts.slice(lo, hi - lo), window, anchor), []
                for k in range(hi - lo):
                    a = _aligned(b, k, marks[lo + k], found[lo + k])
                    known = [tuple(s.values()) for s in stretches[lo + k].as_py() or ()]
                    words = (texts[lo + k].as_py() or "").encode().split()
                    rows += rows_of(owners[lo + k], words, a.factors(window, known) if a else [])
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return told.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: words, words removed, the digest of what is kept, and its factors."""

    def rows_of(owner, words: list[bytes], factors: list) -> list[tuple]:
        gone = np.zeros(len(words) + 1, dtype=np.int32)
        for start, n, _, _ in factors:
            gone[start] += 1
            gone[start + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)] if factors else words
        return [(owner, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), len(factors))]

    return _factored(docs, window, anchor, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long", rows_of)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row a factor: the span, its words, and another place with the same words (row key and word)."""

    def rows_of(owner, words: list[bytes], factors: list) -> list[tuple]:
        return [(owner, start, n, key, at, b" ".join(words[start : start + n]).decode()) for start, n, key, at in factors]

    return _factored(docs, window, anchor, "doc_id long, start long, n_words long, ref_key long, ref_start long, span string", rows_of)


ORACLE_SQL = rf"""
with d as (select doc_id, row_number() over () as k, coalesce(regexp_extract_all(text, '[^ \t-\r]+'), []) as w from documents),
p as (select k, w, unnest(generate_series(1, len(w))) as i from d),
s as (select k, i, w[i] as word, case when i + {WINDOW - 1} <= len(w) then array_to_string(w[i:i + {WINDOW - 1}], ' ') end as span from p),
c as (select k, i, word, case when span is not null and count(*) over (partition by span) > 1 then 1 else 0 end as again from s),
g as (select k, i, word, max(again) over (partition by k order by i rows between {WINDOW - 1} preceding and current row) as gone from c),
o as (select k, sum(gone)::bigint as n_removed, coalesce(string_agg(case when gone = 0 then word end, ' ' order by i), '') as kept from g group by k)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(o.n_removed, 0)::bigint as n_removed, sha256(coalesce(o.kept, '')) as kept_sha256
from d left join o using (k)
"""
