"""Mixing sources to target weights by weighted fair queueing.

Every document gets a pseudo-random place within its source. Its virtual finish time is the number
of tokens of its source up to and including it, divided by the source's target; a second copy of the
source follows the first. All copies of all sources are range-sorted by that time and the order is
cut at the total budget. As a source reaches its target at time 1, the cut falls there for all.

Prefix sums run in two levels. Rows are dealt to buckets of a range of keys (a hash prefix within a
source, a range of virtual time overall); only the sums of buckets are ordered as a whole, and rows
are ordered within their bucket. A source with a third of all rows is spread over as many buckets as
its share, so no task gets more than a bucket. What is taken of a source is all before some place, so
a place a source and copy tells every document how often it is taken: texts are never shuffled.

Defined results: size is the number of words (null text: 0). A null source is a source of its own,
ordered last. Documents without words are never taken. Repeated rows, and rows that share an id or
have none, are documents of their own; their places follow from id and text, and of rows that agree in
both it does not matter which is taken. Sources without words have target 0. An empty table gives an
empty result. ``mix`` drops extra columns, ``mixed_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import few, keyed, materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1_000
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(seed: str, unique: bool) -> Column:
    """A document's pseudo-random place within its source; ``__key`` tells rows of one place apart."""
    parts = [F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    if not unique:
        parts += [F.lit(":"), F.coalesce(F.xxhash64("text"), F.lit(0)).cast("string")]
    return F.md5(F.concat(*parts))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, rank, source_size, target``: weights in turn, capped at ``cap`` times the size.

    What a capped source can't take goes to the others by weight. Ordered by cap over weight, the
    capped ones come first, so the level of the others is found in one pass over the sources.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = total.withColumn("rank", rank).withColumn("weight", choice).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    s = (
        s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("rest"))
        .withColumn("place", F.row_number().over(order))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))
    s = s.withColumn("level", F.min_by("level", fits).over(everything))
    return s.select("source", "rank", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")).alias("target"), "budget")


def _taken(docs: DataFrame, unique: bool, weights: tuple[float, ...], share: float, cap: int, seed: str, bucket_rows: int) -> tuple[DataFrame, Column, Column]:
    """Of keyed documents: their places in the order, how often each is taken, and its first copy's finish time."""
    sized = docs.select("__key", "doc_id", "source", word_count(F.col("text")).alias("size"), _place(seed, unique).alias("key"))
    sized = materialize(sized, "mix-sizes")
    n = sized.count()
    digits = next(k for k in range(16) if n <= bucket_rows * 16**k)
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))

    targets = source_targets(sized, weights, share, cap)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = sums.select("source", "bucket", before.alias("before")).alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("t.*", "b.bucket", "b.before")
    within = Window.partitionBy("source", "bucket").orderBy("key", "__key").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("inside", F.sum("size").over(within)).alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source and d.bucket = p.bucket"))
    placed = placed.select("d.__key", "d.doc_id", "d.source", "d.size", "d.key", "p.rank", "p.source_size", "p.target", "p.budget", (F.col("p.before") + F.col("d.inside")).alias("upto"))
    placed = materialize(placed, "mix-places")

    def finish(epoch: int) -> Column:
        return F.try_divide((F.col("source_size") * epoch + F.col("upto")).cast("double"), F.col("target"))

    # The cut: the last copy, in order of (finish, rank, epoch, place), within the budget.
    per_unit = max(1, round(n / bucket_rows))
    copies = placed.where("size > 0").select("rank", "size", "upto", "budget", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), finish(e).alias("finish")) for e in range(cap)])).alias("c")).select("rank", "size", "upto", "budget", "c.*").withColumn("slot", F.floor(F.col("finish") * per_unit))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"), F.max("budget").alias("budget"))
    upto_slot = F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    edge = slots.withColumn("upto_slot", upto_slot).where("upto_slot > budget").agg(F.min_by(F.struct("slot", (F.col("upto_slot") - F.col("slot_size")).alias("spent"), "budget"), "slot").alias("e")).first().e
    if edge is None:  # everything fits, or there is nothing
        takes = [F.lit(True)] * cap
    else:
        run = F.sum("size").over(Window.orderBy("finish", "rank", "epoch", "upto").rowsBetween(Window.unboundedPreceding, 0))
        last = copies.where(F.col("slot") == edge.slot).withColumn("run", run).where(F.col("run") + edge.spent <= edge.budget).agg(F.max(F.struct("finish", "rank", "epoch", "upto")).alias("m")).first().m
        end = (last.finish, last.rank, last.epoch, last.upto) if last else (edge.slot / per_unit, 0, 0, 0)
        kinds = ("double", "int", "int", "long")

        def order(*parts: Column) -> Column:
            return F.struct(*[p.cast(k).alias(f"k{i}") for i, (p, k) in enumerate(zip(parts, kinds))])

        takes = [F.coalesce(order(finish(e), F.col("rank"), F.lit(e), F.col("upto")) <= order(*map(F.lit, end)), F.lit(False)) for e in range(cap)]
    takes = [(F.col("size") > 0) & t for t in takes]
    return placed.withColumns({f"take{e}": t for e, t in enumerate(takes)}), reduce(Column.__add__, [F.col(f"take{e}").cast("int") for e in range(cap)]), finish(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the first copy's finish time."""
    rows, unique = keyed(docs.select("doc_id", "source", "text"), "mix-docs")
    placed, count, finish = _taken(rows, unique, weights, share, cap, seed, bucket_rows)
    return placed.select("doc_id", "source", "size", "source_size", "target", count.alias("copies"), (count * F.col("size")).cast("long").alias("taken"), finish.alias("finish"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents of the mix themselves, a document taken twice being there twice."""
    rows, unique = keyed(docs, "mix-docs")
    placed, _, _ = _taken(rows.select("__key", "doc_id", "source", "text"), unique, weights, share, cap, seed, bucket_rows)
    ends = placed.groupBy("source").agg(*[F.max(F.when(F.col(f"take{e}"), F.struct("key", "__key"))).alias(f"__end{e}") for e in range(cap)])
    ends = materialize(ends.withColumnRenamed("source", "__source"), "mix-ends")
    here = F.struct(F.col("__place").alias("key"), F.col("__key"))
    count = reduce(Column.__add__, [F.coalesce((here <= F.col(f"__end{e}")).cast("int"), F.lit(0)) for e in range(cap)])
    told = rows.withColumn("__place", _place(seed, unique)).join(few(ends), F.col("source").eqNullSafe(F.col("__source")), "left")
    told = told.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("__copies", count).where("__copies > 0")
    return told.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^ \t-\r]+')) end as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
named as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from sized group by source),
weighed as (
  select *, case (rank - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, source_size * 2.0::double as most,
         (sum(source_size) over ())::double * 1.5::double as budget from named),
levels as (
  select *, (budget - coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by most / weight, rank rows between current row and unbounded following) as level,
         row_number() over (order by most / weight, rank) as place from weighed),
level as (select arg_min(level, place) as level from levels where level * weight <= most),
targets as (
  select source, rank, source_size, budget, coalesce(least(most, l.level * weight), most) as target from levels, level l),
placed as (
  select d.doc_id, d.source, d.size, t.rank, t.source_size, t.target, t.budget,
         sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding)::bigint as upto
  from sized d join targets t on d.source is not distinct from t.source),
copies as (
  select doc_id, size, rank, upto, budget, epoch, (source_size * epoch + upto)::double / target as finish
  from placed, (values (0), (1)) e(epoch) where size > 0),
cut as (
  select doc_id, size, sum(size) over (order by finish, rank, epoch, upto rows unbounded preceding)::bigint <= budget as kept from copies),
took as (select doc_id, sum(size)::bigint as taken from cut where kept group by doc_id)
select p.doc_id, p.size::bigint as size, p.source_size, p.target, coalesce(k.taken, 0)::bigint as taken
from placed p left join took k on k.doc_id = p.doc_id
"""
