"""Operator 6: mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, shuffled by a seeded hash, form one stream of words
that is cut into equal blocks and repeats when it ends. Slot t of the schedule
goes to the source into whose share of the cumulative weights the golden-ratio
point frac((t + 0.5) * phi) falls; a source's k-th slot takes its k-th block. A
source's slots end when its target is met (the last block is cut there), and
sources that the points left short get their missing slots at the end.

Targets share out all sources' sizes by weight; none exceeds `max_repeats`
times its source's size, the excess going to the others by weight (water
filling, solved exactly from running sums).

Everything is relational. The shuffle key is a digest of seed, id and text, so
rows without an id and rows that share one are spread like the others; equal
rows are summed up and dealt out again. Positions within a source come from
sums over 4096 hash ranges and a running sum inside each range, so a source with
any share of the rows is spread over that many tasks.

Defined cases: null text has size 0 and is never taken; a null source is a
source, ordered last; repeated rows are documents of their own; a source whose
documents are all empty has target 0; an empty table gives an empty mix; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

CYCLE = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20_240_601
#: A source's shuffled order is cut into 16 to this power ranges of its hash.
SHUFFLE_DIGITS = 3
#: Blocks that the smallest target gets, unless the schedule would exceed MAX_SLOTS.
SLOTS_OF_SMALLEST = 64
MAX_SLOTS = 2_000_000
#: Sources up to which their table is broadcast to the documents; more go through a shuffled join.
MAX_BROADCAST_SOURCES = 50_000
#: Cells that cut the cumulative weights for the join of points and sources.
GRID = 4096
_GOLDEN = 0.6180339887498949


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target): one row for each source.

    With r = cap / weight ascending, the level x solves sum(min(cap, x * weight)) = total;
    the sources before the solution's place are capped. Windows here run over one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.row_number().over(by_name) - 1) % len(cycle) + 1)
    return (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_repeats))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("first.level"), F.col("ratio")) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def block_words(plan: DataFrame) -> tuple[int, int]:
    """(words in a block, slots in the schedule) for the plan's targets; (1, 0) if nothing is to be taken."""
    stats = plan.agg(F.sum("target").alias("total"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    if not stats.total:
        return 1, 0
    block = max(1, int(stats.least // SLOTS_OF_SMALLEST), int(stats.total // MAX_SLOTS))
    return block, int(-(-stats.total // block))


def schedule(plan: DataFrame, block: int, slots: int) -> DataFrame:
    """(slot, sid, rank, begin, words): the source whose next block each slot takes, and the words of it.

    Points meet the sources' intervals of cumulative weight by an equi-join on a grid cell and a check of the ends.
    """
    spark = plan.sparkSession
    by_sid = W.orderBy("sid")
    low = F.coalesce(F.sum("target").over(by_sid.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    shares = (
        plan.withColumn("low", low / F.sum("target").over(W.partitionBy()))
        .withColumn("high", F.coalesce(F.lead("low").over(by_sid), F.lit(1.0)))
        .withColumn("quota", F.floor("target"))
        .withColumn("needed", F.ceil(F.floor("target") / F.lit(block)))
    )
    cells = shares.filter("high > low").select(
        "sid", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * GRID), F.floor(F.col("high") * GRID))).alias("cell"),
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 0.5D) * {_GOLDEN}D, 1D)").alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * GRID))
    placed = points.join(cells, "cell").filter("low <= point AND point < high").select("slot", "sid")
    counts = placed.groupBy("sid").count()
    missing = (
        shares.join(counts, "sid", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .filter("needed > count")
        .select("sid", F.explode(F.sequence(F.col("count"), F.col("needed") - 1)).alias("rank"))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    )
    begin = F.col("rank") * F.lit(block)
    return (
        _ranked(placed)
        .unionByName(missing)
        .join(shares.select("sid", "quota", "needed"), "sid")
        .filter("rank < needed")
        .select("slot", "sid", "rank", begin.alias("begin"), F.least(F.lit(block), F.col("quota") - begin).alias("words"))
    )


def _ranked(placed: DataFrame) -> DataFrame:
    """Ranks a source's slots in two steps, over ranges of slots first, so that no task holds a large source's slots."""
    part = F.floor(F.col("slot") / 8192)
    inside = W.partitionBy("sid", "part").orderBy("slot")
    cut = placed.withColumn("part", part)
    before = (
        cut.groupBy("sid", "part")
        .count()
        .withColumn("before", F.sum("count").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
        .select("sid", "part", F.coalesce("before", F.lit(0)).alias("before"))
    )
    return (
        cut.withColumn("rank", F.row_number().over(inside) - 1)
        .join(before, ["sid", "part"])
        .select("slot", "sid", (F.col("rank") + F.col("before")).alias("rank"))
    )


def _stream(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, n, order): the documents' sizes and shuffle keys; equal rows are one, n times."""
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))
    return docs.select("doc_id", "source", size_of("text").alias("size"), order.alias("order")).groupBy("doc_id", "source", "size", "order").agg(F.count("*").alias("n"))


def _copies(placed: DataFrame) -> DataFrame:
    """One row for each copy, with its own place in the stream; a row that stands many times is dealt out in stretches."""
    stretch = 4096
    single = placed.filter("n = 1").drop("n")
    many = placed.filter("n > 1").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stretch))))
    dealt = many.repartition("order", "first").withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("n"), F.col("first") + stretch) - 1)))
    return single.unionByName(dealt.withColumn("offset", F.col("offset") + F.col("copy") * F.col("size")).drop("n", "first", "copy"))


def _placed(docs: DataFrame, cycle: tuple[int, ...], max_repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, source_size, target, sid, offset) of each document, and the plan of the sources."""
    sized = checkpoint(_stream(docs, seed))
    plan = targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")), cycle, max_repeats)
    plan = checkpoint(plan.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long")))
    few = plan.count() <= MAX_BROADCAST_SOURCES
    placed = sized.join(F.broadcast(plan) if few else plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = placed.withColumn("part", F.left("order", F.lit(SHUFFLE_DIGITS)))
    words = F.col("size") * F.col("n")
    sums = placed.groupBy("sid", "part").agg(F.sum(words).alias("part_size"))
    sums = sums.withColumn(
        "before", F.sum("part_size").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ).select("sid", "part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = W.partitionBy("sid", "part").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(sums, ["sid", "part"])
    placed = placed.withColumn("offset", F.col("offset") + F.col("before"))
    return _copies(placed.select("doc_id", "source", "size", "source_size", "target", "sid", "offset", "order", "n")).drop("order"), plan


def _served(placed: DataFrame, plan: DataFrame, max_repeats: int) -> DataFrame:
    """(slot, sid, offset, doc_id, source, begin, words): the words of a document, from `begin` of its text on, that a slot serves."""
    block, count = block_words(plan)
    slots = schedule(plan, block, count).select("slot", "sid", "rank", F.col("begin").alias("low"), (F.col("begin") + F.col("words")).alias("high"))
    # Each pass over the stream puts the document at offset + epoch * source_size; it meets the blocks in between.
    passes = placed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    passes = passes.withColumn("start", F.col("offset") + F.col("epoch") * F.col("source_size")).filter("start < target")
    met = passes.select(
        "sid", "offset", "doc_id", "source", "start", (F.col("start") + F.col("size")).alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("rank"),
    )
    begin = F.greatest("start", "low")
    served = met.join(slots, ["sid", "rank"]).withColumn("words", F.least("end", "high") - begin).filter("words > 0")
    return served.select("slot", "sid", "offset", "doc_id", "source", (begin - F.col("start")).alias("begin"), "words")


def order(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(slot, doc_id, source, begin, words): the mix in the order of the schedule.

    Slot after slot serves one block of its source: `words` words of a document from its word `begin` on.
    """
    placed, plan = _placed(docs, cycle, max_repeats, seed)
    return _served(placed, plan, max_repeats).select("slot", "doc_id", "source", "begin", "words")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, n_slots) for each row of docs.

    taken: the words that the slots serve of it; first_slot and n_slots: the first slot that does, and how many do.
    """
    placed, plan = _placed(docs, cycle, max_repeats, seed)
    placed = checkpoint(placed)
    taken = _served(placed, plan, max_repeats).groupBy("sid", "offset").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.countDistinct("slot").alias("n_slots")
    )
    # Documents with words have offsets of their own within a source; those without meet nothing.
    words = placed.filter("size > 0").join(taken, ["sid", "offset"], "left")
    none = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_slots": F.lit(0).cast("long")})
    return words.unionByName(none.select(*words.columns)).select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
    )
