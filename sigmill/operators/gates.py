"""Predicates and band joins: who is eligible, visible, comparable and in the window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unknown_to_null
from ..functions.vectors import is_valid
from .blocks import with_blocks
from .shared import checkpoint

EXCLUDED_TYPES = ("UNKNOWN", "UNRELATED_OR_AMBIGUOUS")
CONTRACT = ("model_id", "model_revision", "embedding_dimension", "normalization", "input_format", "distance_metric")
#: Rows of a part of a key, about; parts meet in pairs.
PART = 8192
#: Pairs, before filters, and rows of a task, about.
TASK_PAIRS = 1 << 26
TASK_ROWS = 1 << 16
#: Rows that each row of the other side meets in turn.
PIECE = 256


def micros(column: str | Column) -> Column:
    """Microseconds since 1970, a whole number, of a timestamp with or without zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def is_eligible(symptom: str = "symptom", issue_type: str = "issue_type") -> Column:
    return F.col(symptom).isNotNull() & ~F.col(issue_type).isin(*EXCLUDED_TYPES)


def is_public(status: Column, last_report_at: Column, window: Column, now: Column) -> Column:
    """Detected or reviewed signals: under review always, otherwise while the window after the last report is open."""
    inside = last_report_at + F.make_dt_interval(secs=window) >= now
    return status.isin("SIGNAL_DETECTED", "UNDER_REVIEW") & ((status == "UNDER_REVIEW") | inside)


def wildcard_equal(a: Column, b: Column) -> Column:
    """Null matches everything."""
    return a.isNull() | b.isNull() | (a == b)


def _gathered(rows: DataFrame, keys: list[str], same: list[str], held: list[str], parts: Column) -> DataFrame:
    """(keys, same, part, parts, found): `held` of rows that agree in keys and same, in order, as an array; one for each part of a key."""
    part = F.pmod(F.xxhash64(F.lit(1), *held), parts).cast("int")
    return rows.groupBy(*keys, *same, parts.alias("parts"), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(*held))).alias("found"))


def _met(left: DataFrame, right: DataFrame, keys: list[str], same: list[str], ours: list[str], theirs: list[str], agree: Callable[[str], Column], below: str | None = None) -> DataFrame:
    """Rows of left (keys, same, ours) with those of right (keys, same, theirs; the last two get the suffix _r) that have equal keys, of
    which no one is null, and agree in each column of `same`.

    Rows alike but for what is listed last meet as arrays, which become pairs after the join alone. Keys are cut into parts of PART
    rows, and pairs of parts dealt to tasks. A row of left meets PIECE rows of right, then the next meets these: as no column changes
    without order, a file of pairs needs a small share of the bytes of its values. below: only pairs with a lesser left value of
    this column, the first that both list; pieces without any are left out before they become rows.
    """
    left, right = left.dropna(subset=keys), right.dropna(subset=keys)
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n")).join(right.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    large = checkpoint(sizes.withColumn("_parts", F.struct(*[F.ceil(F.col(c) / PART).cast("int").alias(c) for c in "nm"])))
    whole = large.agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs"), F.sum(F.col("n") + F.col("m")).alias("rows")).first()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((whole.pairs or 0) / TASK_PAIRS), (whole.rows or 0) // TASK_ROWS)
    cut = large.filter(F.greatest("n", "m") > PART).select(*keys, "_parts")

    def side(rows: DataFrame, held: list[str], own: str, other: str) -> DataFrame:
        placed = with_blocks(rows, cut, keys, held[0], "_parts", F.struct(F.lit(1).alias("n"), F.lit(1).alias("m")))
        found = _gathered(placed.withColumn("_other", F.col(f"_parts.{other}")), [*keys, "_other"], same, held, F.col(f"_parts.{own}"))
        return found.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_other") - 1))).withColumnRenamed("part", "_a").drop("parts", "_other")

    dealt = [*keys, "_a", "_b"]
    a = side(left, ours, "n", "m").withColumnRenamed("found", "_ours").repartition(tasks, *dealt)
    b = side(right, theirs, "m", "n").select(*keys, F.col("_b").alias("_a"), F.col("_a").alias("_b"), F.col("found").alias("_theirs"), *[F.col(c).alias(f"{c}_r") for c in same])
    met = a.join(b.repartition(tasks, *dealt), dealt)
    for c in same:
        met = met.filter(agree(c))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("_theirs") - 1) / PIECE).cast("int")), lambda i: F.slice("_theirs", i * PIECE + 1, PIECE))
    met = met.withColumn("_theirs", F.explode(pieces)).withColumn("_ours", F.explode("_ours"))
    if below is not None:
        met = met.filter(F.col(f"_ours.{below}") < F.element_at("_theirs", -1)[below])
    met = met.withColumn("_theirs", F.explode("_theirs"))
    if below is not None:
        met = met.filter(F.col(f"_ours.{below}") < F.col(f"_theirs.{below}"))
    taken = [*[F.col(f"_ours.{c}").alias(c) for c in ours], *[F.col(f"_theirs.{c}").alias(f"{c}_r") for c in theirs]]
    return met.select(*keys, *same, *[f"{c}_r" for c in same], *taken)


def gate_pairs(left: DataFrame, right: DataFrame, keys: list[str], wildcards: list[str], below: str | None = None) -> DataFrame:
    """Joins on equal keys and wildcard-equal columns; right's columns other than the keys get the suffix _r.

    below: a column of both by which the left row must come before the right one, as where a table meets itself.
    """
    ours, theirs = [c for c in left.columns if c not in [*keys, *wildcards]], [c for c in right.columns if c not in [*keys, *wildcards]]
    if below is not None:
        ours, theirs = ([below, *[c for c in held if c != below]] for held in (ours, theirs))
    met = _met(left, right, keys, wildcards, ours, theirs, lambda c: wildcard_equal(F.col(c), F.col(f"{c}_r")), below)
    return met.select(*keys, *left.drop(*keys).columns, *[f"{c}_r" for c in right.drop(*keys).columns])


def known_filters(reports: DataFrame) -> DataFrame:
    """Adds the filters of a gate: an unknown submission status filters nothing."""
    return reports.withColumn("submission_filter", unknown_to_null(F.col("submission_status"))).withColumn("error_filter", F.col("error_code"))


def window_pairs(reports: DataFrame, window: int, keys: list[str], id_col: str = "report_id", time_col: str = "received_at") -> DataFrame:
    """(keys, left_id, right_id, gap): pairs of rows with equal keys at most `window` seconds apart (gap), left_id < right_id.

    Time is cut into buckets of one window; a row meets its own bucket and both
    neighbours, so the join is an equi-join with a residual check, not a range scan.
    """
    at = micros(time_col)
    bucket = F.floor(at / (window * 1_000_000))
    rows = reports.select(*keys, F.col(id_col).alias("id"), at.alias("at"), bucket.alias("bucket"))
    around = rows.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.col("bucket") + i)))
    met = _met(around, rows, [*keys, "bucket"], ["at"], ["id"], ["id"], lambda c: F.abs(F.col(c) - F.col(f"{c}_r")) <= window * 1_000_000, "id")
    gap = F.abs(F.col("at") - F.col("at_r")) / 1_000_000
    return met.select(*keys, F.col("id").alias("left_id"), F.col("id_r").alias("right_id"), gap.alias("gap"))


def contract_match(rows: DataFrame, contract: dict[str, object], vector: str = "vec") -> Column:
    """All metadata equal, the length as stated, all components finite."""
    same = [F.col(c) == F.lit(contract[c]) for c in CONTRACT if c in rows.columns]
    out = is_valid(F.col(vector), int(contract["embedding_dimension"]))
    for s in same:
        out = out & s
    return out


def violations(table: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """(table_name, rule, violations): how many rows break each rule; a null condition breaks nothing."""
    counted = table.agg(*[F.count_if(F.coalesce(~rule, F.lit(False))).alias(key) for key, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])
    return counted.select(F.lit(name).alias("table_name"), F.inline(pairs))
