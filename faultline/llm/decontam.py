"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask such as ``11010011`` selects token positions; a seed is the hash of the selected tokens at a
position. Test and training seeds are joined, and around every hit the test item is laid along the
document and compared token by token. A document is contaminated by an item when ``WINDOW``
consecutive tokens of the item stand in the document with at most ``SUBSTITUTIONS`` replaced. The
default mask is lossless: whichever two of thirteen tokens are replaced, the mask fits somewhere
over unchanged ones (tests check this), so the result equals an exhaustive comparison.

Tokens are lower-cased runs of characters other than ASCII white space and punctuation.

Only ids and positions of hits are shuffled: the seeds of the items are broadcast if a count shows that
they are few, and the documents that are laid against items are found again by their ids, again by a
broadcast if those are few. Beyond ``storage.BROADCAST_ROWS`` both are joined by a shuffle.

Defined results: items of fewer than ``WINDOW`` tokens must occur whole, those of ``SHORT`` tokens or
more with at most ``loose`` replaced (none unless asked for), shorter ones exactly; items of fewer than
``short`` tokens match nothing (the registered query and the pipeline take ``short=1, loose=1``); null and empty texts have no tokens; repeated rows with one
id give one result row; a null doc_id or item_id is an id like any other; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import few, materialize, without

WINDOW = 13
SUBSTITUTIONS = 2
SHORT = 8
MASKS = ("11010011",)
_GAP = r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _seeds(hashes: Column, mask: str) -> Column:
    """One seed for each position at which the mask fits."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(hashes) - len(mask)
    positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in picked]))


def _places(table: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """``key, mask, at, seed`` of a table with a column ``hashes``."""
    out = None
    for m, mask in enumerate(masks):
        part = table.select(key, F.lit(m).alias("mask"), F.posexplode(_seeds(F.col("hashes"), mask)).alias("at", "seed"))
        out = part if out is None else out.unionByName(part)
    return out


def _loose(n: int, loose: int) -> int:
    return loose if n >= SHORT else 0


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, short: int = SHORT, masks: tuple[str, ...] = MASKS, loose: int = 0) -> DataFrame:
    """``doc_id, item_id, item_words, matched_words, places``: which item is in which document.

    ``matched_words`` is the most tokens of the item that stand at their places along one alignment,
    ``places`` the number of alignments with a window that fits.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") >= short)
    hashed = items.select("item_id", F.size("item").alias("n"), F.transform("item", lambda w: F.xxhash64(w)).alias("hashes"))
    theirs = docs.select("doc_id", F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))

    hashed = materialize(hashed, "leak-items")
    seeds = few(materialize(_places(hashed.where(F.col("n") >= window), "item_id", masks), "leak-seeds"))
    hits = _places(theirs, "doc_id", masks).alias("d").join(seeds.alias("i"), ["mask", "seed"])
    hits = hits.select("doc_id", "item_id", (F.col("d.at") - F.col("i.at")).alias("shift"))
    # Short items are cut into one piece more than tokens may be replaced, so one piece is unchanged.
    little = hashed.where(F.col("n") < window)
    pieces: dict[int, list[tuple[int, int]]] = {}
    for n in sorted(r.n for r in little.select("n").distinct().collect()):  # fewer than ``window`` numbers
        cuts = [n * i // (_loose(n, loose) + 1) for i in range(_loose(n, loose) + 2)]
        for at, end in zip(cuts, cuts[1:]):
            pieces.setdefault(end - at, []).append((n, at))
    for width, places in pieces.items():
        mask = ("1" * width,)
        parts = [_places(little.where(F.col("n") == n), "item_id", mask).where(F.col("at") == at) for n, at in places]
        pieces_of_width = few(materialize(reduce(DataFrame.unionByName, parts), "leak-seeds"))
        short_hits = _places(theirs, "doc_id", mask).alias("d").join(pieces_of_width.alias("i"), ["mask", "seed"])
        hits = hits.unionByName(short_hits.select("doc_id", "item_id", (F.col("d.at") - F.col("i.at")).alias("shift")))
    hits = materialize(hits.distinct(), "leak-hits")
    hit_ids = materialize(hits.select(F.col("doc_id").alias("__hit")).distinct(), "leak-ids")

    words = docs.join(few(hit_ids), docs["doc_id"].eqNullSafe(hit_ids["__hit"]), "left_semi").select("doc_id", tokens(F.col("text")).alias("words"))
    laid = words.alias("w").join(hits.alias("h"), F.expr("w.doc_id <=> h.doc_id")).select("h.doc_id", "h.item_id", "h.shift", "w.words")
    laid = laid.alias("l").join(items.alias("i"), F.expr("l.item_id <=> i.item_id")).select("l.doc_id", "l.item_id", "l.shift", "l.words", "i.item")
    same = F.transform("item", lambda w, j: F.coalesce((F.when(F.col("shift") + j >= 0, F.get("words", F.col("shift") + j)) == w).cast("int"), F.when((F.col("shift") + j < 0) | (F.col("shift") + j >= F.size("words")), F.lit(-window)).otherwise(F.lit(0))))
    laid = laid.select("doc_id", "item_id", "shift", F.size("item").alias("item_words"), same.alias("same"))
    span = F.least(F.col("item_words"), F.lit(window))
    needed = F.when(F.col("item_words") >= window, F.lit(window - substitutions)).when(F.col("item_words") >= SHORT, F.col("item_words") - loose).otherwise(F.col("item_words"))
    fits = F.exists(F.sequence(F.lit(1), F.col("item_words") - span + 1), lambda s: F.aggregate(F.slice("same", s, span), F.lit(0), lambda a, x: a + x) >= needed)
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))
    found = laid.where(fits).select("doc_id", "item_id", "shift", "item_words", matched.alias("matched")).distinct()
    return found.groupBy("doc_id", "item_id").agg(F.first("item_words").cast("long").alias("item_words"), F.max("matched").cast("long").alias("matched_words"), F.countDistinct("shift").alias("places"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no item contaminates, unchanged."""
    return without(docs, contaminated(docs, benchmark, **how).select("doc_id"), "doc_id", "leak-bad")


#: With two of thirteen tokens replaced, four neighbours are still unchanged: candidates by 4-grams.
ORACLE_SQL = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_GAP}'), lambda x: x <> '') as w from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_GAP}'), lambda x: x <> '') as w from benchmark),
dp as (select doc_id, w, unnest(generate_series(1, len(w) - 3)) as p from d where len(w) >= 4),
ip as (select item_id, w, unnest(generate_series(1, len(w) - 3)) as p from i where len(w) >= {SHORT}),
dg as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] as g from dp),
ig as (select item_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] as g from ip),
shifts as (select distinct doc_id, item_id, dg.p - ig.p as s from dg join ig using (g)),
laid as (
  select s.doc_id, s.item_id, s.s, len(i.w) as n,
         list_transform(generate_series(1, len(i.w)), lambda j: case when j + s.s < 1 or j + s.s > len(d.w) then -{WINDOW} when d.w[j + s.s] = i.w[j] then 1 else 0 end) as same
  from shifts s join d on d.doc_id = s.doc_id join i on i.item_id = s.item_id),
fits as (
  select *, list_sum(list_transform(same, lambda x: greatest(x, 0))) as matched from laid
  where list_max(list_transform(generate_series(1, n - least(n, {WINDOW}) + 1), lambda a: list_sum(list_slice(same, a, a + least(n, {WINDOW}) - 1))))
        >= case when n >= {WINDOW} then {WINDOW - SUBSTITUTIONS} else n end)
select doc_id, item_id, max(n)::bigint as item_words, max(matched)::bigint as matched_words, count(distinct s)::bigint as places
from fits group by doc_id, item_id
"""
