"""Quality metrics of classification, pair scores and clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import matrix, pairwise, rounded

#: The gates of model selection and acceptance.
PRECISION_FLOOR = 0.80
MIN_ACCURACY, MIN_CLASS_ACCURACY, MAX_ATTEMPTS = 0.85, 0.75, 1.3


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def with_prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; all 0 where undefined."""
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    out = out.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def levels_of(vectors: DataFrame, keys: list[str], low: int, high: int, digits: int = 6) -> DataFrame:
    """(level, same, n): the pairs of vectors with equal keys, by the last threshold low/100 to high/100 that they reach.

    vectors: keys, vec_id, vec, label; same: equal labels. Blocks of vectors are multiplied, and only their counts leave a task.
    """

    def compare(left, right, same):
        import numpy as np
        import pyarrow as pa

        scores = rounded(np.clip(matrix(left, "vec") @ matrix(right, "vec").T, -1, 1), digits)
        level = np.clip(np.floor(scores * 100 + 1e-9), low - 1, high).astype(np.int64) - (low - 1)
        alike = left.column("label").to_numpy()[:, None] == right.column("label").to_numpy()[None]
        counted = np.ones(scores.shape, bool)
        if same:
            counted = np.triu(counted, 1)
        n = np.bincount((2 * level + alike)[counted], minlength=2 * (high - low + 2))
        at = np.flatnonzero(n)
        return pa.table({"level": pa.array(at // 2 + low - 1, pa.int32()), "same": pa.array(at % 2 == 1), "n": pa.array(n[at], pa.int64())})

    return pairwise(vectors.select(*keys, "vec_id", "vec", "label"), keys, "vec_id", compare, "level int, same boolean, n long")


def threshold_counts(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """(threshold, tp, fp, fn, tn, ...) for thresholds low/100 to high/100; pairs: similarity, same.

    Each pair is counted once, at the last threshold it reaches.
    """
    reached = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.floor(F.col("similarity") * 100 + F.lit(1e-9)))).cast("int")
    return counts_of_levels(pairs.select(reached.alias("level"), "same", F.lit(1).cast("long").alias("n")), low, high)


def counts_of_levels(levels: DataFrame, low: int, high: int) -> DataFrame:
    """As threshold_counts, from (level, same, n); running sums over the few thresholds do the rest."""
    level = levels.groupBy("level").agg(
        F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("n")
    )
    steps = levels.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("level")).join(level, "level", "left")
    whole = steps.fillna(0).groupBy().agg(F.array_sort(F.collect_list(F.struct("level", "p", "n"))).alias("steps"))
    # At most a hundred entries.
    out = whole.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("step"), "steps")

    def total(name: str, above: bool) -> Column:
        kept = F.filter("steps", lambda e: (e["level"] >= F.col("step")) if above else (e["level"] < F.col("step")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda s, e: s + e[name])

    return with_prf(
        out.select(
            (F.col("step") / 100).alias("threshold"),
            total("p", True).alias("tp"),
            total("n", True).alias("fp"),
            total("p", False).alias("fn"),
            total("n", False).alias("tn"),
        )
    )


def labelled_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (left_label, right_label, left_type, right_type, ...) with reason: null for a pair that counts, else why it does not.

    A pair counts if both sides have a label and their issue types are equal.
    """
    left, right = F.col("left_label").isNull(), F.col("right_label").isNull()
    reason = F.when(left & right, "BOTH_UNLABELLED").when(left, "LEFT_UNLABELLED").when(right, "RIGHT_UNLABELLED")
    return pairs.withColumn("reason", reason.when(~F.col("left_type").eqNullSafe(F.col("right_type")), "TYPE_MISMATCH"))


def describe_pairs(pairs: DataFrame) -> DataFrame:
    """(reason, same, pairs, least, mean, most) of the similarity of labelled_pairs: excluded ones by reason, the others by equal labels."""
    same = F.when(F.col("reason").isNull(), F.col("left_label") == F.col("right_label"))
    value = F.when(F.col("reason").isNull(), F.col("similarity"))
    return pairs.groupBy("reason", same.alias("same")).agg(F.count("*").alias("pairs"), F.min(value).alias("least"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))


def pair_spans(vectors: DataFrame, keys: list[str], missing: int, digits: int = 6) -> DataFrame:
    """(same, excluded, pairs, least, mean, most) of the similarities of all pairs with equal keys.

    vectors: keys, vec_id, vec, label; excluded: one of the labels is `missing`.
    """

    def compare(left, right, same):
        import numpy as np
        import pyarrow as pa

        scores = rounded(np.clip(matrix(left, "vec") @ matrix(right, "vec").T, -1, 1), digits)
        a, b = left.column("label").to_numpy()[:, None], right.column("label").to_numpy()[None]
        group = 2 * (a == b) + ((a == missing) | (b == missing))
        counted = np.triu(np.ones(scores.shape, bool), 1) if same else np.ones(scores.shape, bool)
        found = [(g, scores[counted & (group == g)]) for g in range(4)]
        rows = [(g >= 2, g % 2 == 1, len(x), x.min(), x.sum(), x.max()) for g, x in found if len(x)]
        names = ["same", "excluded", "pairs", "least", "total", "most"]
        kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "same boolean, excluded boolean, pairs long, least double, total double, most double"
    parts = pairwise(vectors.select(*keys, "vec_id", "vec", "label"), keys, "vec_id", compare, schema)
    return parts.groupBy("same", "excluded").agg(
        F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.round(F.sum("total") / F.sum("pairs"), digits).alias("mean"), F.max("most").alias("most")
    )


#: What excludes a pair, in the order in which it is told; the first two are unlabelled on one side, by the smaller and larger id.
_REASONS = (None, "BOTH_UNLABELLED", "LEFT_UNLABELLED", "RIGHT_UNLABELLED", "TYPE_MISMATCH")


def pair_facts(vectors: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """describe_pairs of labelled_pairs over all pairs with equal keys, without a row for a pair.

    vectors: keys, vec_id, vec, label, type; labels and types ride in the blocks, and only counts, sums and ends leave a task.
    """

    def compare(left, right, same):
        import numpy as np
        import pyarrow as pa

        scores = rounded(np.clip(matrix(left, "vec") @ matrix(right, "vec").T, -1, 1), digits)
        ids, labels, types = ([np.array(side.column(c).to_pylist(), object) for side in (left, right)] for c in ("vec_id", "label", "type"))
        none = [np.array([x is None for x in side], bool) for side in labels]
        apart = types[0][:, None] != types[1][None]
        first = ids[0][:, None] < ids[1][None]
        a, b = none[0][:, None], none[1][None]
        # The side with the smaller id is the left one.
        alone_left = np.where(first, a, b) & ~np.where(first, b, a)
        reason = np.where(a & b, 1, np.where(a | b, np.where(alone_left, 2, 3), np.where(apart, 4, 0)))
        group = np.where(reason > 0, reason + 1, (labels[0][:, None] == labels[1][None]).astype(int))
        counted = np.triu(np.ones(scores.shape, bool), 1) if same else np.ones(scores.shape, bool)
        rows = []
        for g in range(6):
            if len(found := scores[counted & (group == g)]):
                ends = (found.min(), found.sum(), found.max()) if g < 2 else (None, None, None)
                rows.append((_REASONS[max(0, g - 1)] if g > 1 else None, g == 1 if g < 2 else None, len(found), *ends))
        kinds = [pa.string(), pa.bool_(), pa.int64(), *[pa.float64()] * 3]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["reason", "same", "pairs", "least", "total", "most"])

    schema = "reason string, same boolean, pairs long, least double, total double, most double"
    parts = pairwise(vectors.select(*keys, "vec_id", "vec", "label", "type"), keys, "vec_id", compare, schema)
    return parts.groupBy("reason", "same").agg(
        F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.round(F.sum("total") / F.sum("pairs"), digits).alias("mean"), F.max("most").alias("most")
    )


def select_threshold(metrics: DataFrame, floor: float = PRECISION_FLOOR) -> DataFrame:
    """The one row with the best (f1, recall, threshold) among those of enough precision."""
    return metrics.filter(F.col("precision") >= floor).orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("threshold").desc()).limit(1)


def cluster_prf(rows: DataFrame) -> DataFrame:
    """One row of pair metrics for (label, cluster) rows, from sums of n over 2 of the contingency table: no pairs are made."""

    def pairs(*keys: str) -> Column:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        return counts.agg(F.coalesce(F.sum(F.expr("n * (n - 1) DIV 2")), F.lit(0)).alias("v"))

    parts = [pairs(*keys).withColumnRenamed("v", name) for keys, name in ((("label", "cluster"), "tp"), (("cluster",), "together"), (("label",), "alike"))]
    n = rows.agg(F.expr("count(*) * (count(*) - 1) DIV 2").alias("all"))
    joined = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(n)  # single rows
    counts = joined.select(
        "tp",
        (F.col("together") - F.col("tp")).alias("fp"),
        (F.col("alike") - F.col("tp")).alias("fn"),
        (F.col("all") - F.col("together") - F.col("alike") + F.col("tp")).alias("tn"),
    )
    return with_prf(counts)


def fragmentation(rows: DataFrame) -> DataFrame:
    """(kind, key, n): clusters of each label, labels of each cluster over one, and the number of single clusters."""
    by_label = rows.groupBy("label").agg(F.count_distinct("cluster").alias("n"))
    by_cluster = rows.groupBy("cluster").agg(F.count_distinct("label").alias("n"), F.count("*").alias("size"))
    return (
        by_label.select(F.lit("clusters_of_label").alias("kind"), F.col("label").cast("string").alias("key"), "n")
        .unionByName(by_cluster.filter("n > 1").select(F.lit("labels_of_cluster").alias("kind"), F.col("cluster").cast("string").alias("key"), "n"))
        .unionByName(by_cluster.filter("size = 1").agg(F.count("*").alias("n")).select(F.lit("singletons").alias("kind"), F.lit("").alias("key"), "n"))
    )


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def class_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected").agg(
        F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("predicted")).alias("correct"), F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("accuracy")
    )


def acceptance(rows: DataFrame, hard_prefix: str | None = None, hard_least: int | None = None) -> DataFrame:
    """One row: accuracy, worst class, mean attempts, failures, share of quotes in the text and of quotes that are the text, hard negatives right, and whether all gates pass.

    rows: case_id, expected, predicted (null for a failure), attempts, quote, text. Cases whose id begins with hard_prefix are
    hard negatives, of which hard_least must be right. passed_strict also wants no quote that is the whole text.
    """
    right = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    quoted = F.col("quote").isNotNull() & F.col("predicted").isNotNull()
    hard = F.lit(False) if hard_prefix is None else F.startswith(F.col("case_id").cast("string"), F.lit(hard_prefix))
    whole = rows.agg(
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg("attempts").alias("mean_attempts"),
        F.coalesce(F.avg(F.when(quoted, F.contains("text", "quote").cast("double"))), F.lit(1.0)).alias("grounded_share"),
        F.coalesce(F.avg(F.when(quoted, (F.col("text") == F.col("quote")).cast("double"))), F.lit(0.0)).alias("full_text_share"),
        F.count_if(F.col("predicted").isNull()).alias("failures"),
        F.count_if(hard).alias("hard_negatives"),
        F.count_if(hard & right).alias("hard_right"),
    )
    worst = rows.groupBy("expected").agg(F.avg(right.cast("double")).alias("a")).agg(F.min("a").alias("worst_class"))
    passed = (
        (F.col("accuracy") >= MIN_ACCURACY)
        & (F.col("worst_class") >= MIN_CLASS_ACCURACY)
        & (F.col("mean_attempts") <= MAX_ATTEMPTS)
        & (F.col("grounded_share") == 1.0)
        & (F.col("failures") == 0)
        & (F.lit(True) if hard_least is None else F.col("hard_right") >= hard_least)
    )
    out = whole.crossJoin(worst).withColumn("passed", passed)  # single rows
    return out.withColumn("passed_strict", F.col("passed") & (F.col("full_text_share") == 0.0))


def run_consistency(runs: DataFrame) -> DataFrame:
    """(case_id, runs, distinct_values, consistent, average, least and largest latency) of repeated runs."""
    return runs.groupBy("case_id").agg(
        F.count("*").alias("runs"),
        F.count_distinct("value").alias("distinct_values"),
        (F.count_distinct("value") == 1).alias("consistent"),
        F.avg("latency").alias("avg_latency"),
        F.min("latency").alias("min_latency"),
        F.max("latency").alias("max_latency"),
    )


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """One row: completed, failed, dead_letter and their sum, processed."""
    return jobs.agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "DEAD_LETTER").alias("dead_letter"),
    ).withColumn("processed", F.col("completed") + F.col("failed") + F.col("dead_letter"))
