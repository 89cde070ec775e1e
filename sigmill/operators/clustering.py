"""Clusterings whose result depends on a sequence of merges or arrivals.

Batch linkage merges pairs of clusters that are each other's best, all of them
in one round, over an issue type of any size: average and complete linkage are
reducible (a merged cluster is never nearer to a third than both its parts
were), so these merges lead to the clusters that merging the best pair first
leads to. A cluster is a row with its summed unit vectors, for complete linkage
the vectors of its rows; rounds compare blocks of clusters. Issue types of at
most `HELD` vectors, from the start or after some rounds, are finished in one
task each, of at most `SMALL` clusters by the plain sequence of merges.

Arrival orders are folds over sorted partitions that hold open clusters, not
their members' vectors; each part of the graph of near pairs is a fold of its own.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .blocks import bipartite, matrix, pairwise, placed, rounded
from .gates import EXCLUDED_TYPES, known_filters, micros
from .graph import components
from .incremental import Cluster, IncrementalGate, Policy
from .shared import checkpoint, release, stored
from .signals import _unit, medoid

__all__ = ["Cluster", "IncrementalGate", "Policy", "batch_clusters", "complete_link", "medoid_greedy", "online_clusters", "order_stability"]

BATCH_THRESHOLD = 0.58
#: Clusters of an issue type up to which one task merges them: three matrices of their similarities are held.
SMALL = 2048
#: Items of an issue type up to which one task clusters them from their vectors alone, with blocks of similarities at most.
HELD = 32_768
#: Vectors of a block that meets another one, and of a step within.
MEETING = 16_384
STEP = 256
#: Ranges of issue types, at most, that are tasks of their own.
SHARES = 64
#: Shares to which islands are dealt, at least: a few long islands should not meet in one task.
ISLAND_SHARES = 256
#: Scores that round to the same value are equal.
DIGITS = 9
#: What rounding may take from the one pair that lifts a mean to the threshold.
NEAR = 1e-9


def similarities(vectors):
    """Cosine matrix; a zero vector has 0 with everything."""
    import numpy as np

    v = np.asarray(vectors, float)
    size = np.linalg.norm(v, axis=1)
    unit = np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0)
    return np.clip(unit @ unit.T, -1, 1)


def agglomerate(sims, threshold: float, linkage: str = "average", sizes=None) -> list[list[int]]:
    """Merges the best pair of clusters while its score reaches the threshold; items are numbered in id order.

    Scores within 1e-9 of the best count as equal, and the pair with the smallest sorted members wins. Sums of cross
    similarities (or minima, for complete linkage) are updated at each merge, so a step costs one row. sizes: how many
    equal rows an item stands for.
    """
    import numpy as np

    n = len(sims)
    members: list[list[int] | None] = [[i] for i in range(n)]
    sizes = np.ones(n) if sizes is None else np.array(sizes, float)
    cross = np.array(sims, float)
    if linkage == "average":
        cross *= sizes[:, None] * sizes
    alive = np.ones(n, bool)
    score = np.array(sims, float)
    np.fill_diagonal(score, -np.inf)
    # Each row's best score and where: only rows that pointed to a merged cluster are searched again.
    at = score.argmax(axis=1) if n > 1 else np.zeros(n, int)
    top = score[np.arange(n), at]
    while True:
        best = top.max() if n > 1 else -np.inf
        if best < threshold:
            break
        rows = np.flatnonzero(top >= best - 1e-9)
        pairs = ((a, b) for a in rows.tolist() for b in np.flatnonzero(score[a] >= best - 1e-9).tolist() if members[a] < members[b])
        a, b = min(pairs, key=lambda p: (members[p[0]], members[p[1]]))
        members[a] = sorted(members[a] + members[b])
        members[b], alive[b] = None, False
        cross[a] = np.minimum(cross[a], cross[b]) if linkage == "complete" else cross[a] + cross[b]
        cross[:, a] = cross[a]
        sizes[a] += sizes[b]
        score[a] = cross[a] if linkage == "complete" else cross[a] / (sizes[a] * sizes)
        score[a, ~alive] = -np.inf
        score[a, a] = -np.inf
        score[:, a] = score[a]
        score[b], score[:, b] = -np.inf, -np.inf
        stale = np.flatnonzero(alive & ((at == a) | (at == b) | (score[a] > top)))
        for i in {a, *stale.tolist()}:
            at[i] = score[i].argmax()
            top[i] = score[i, at[i]]
        top[b] = -np.inf
    return sorted(m for m in members if m)


def average_link(totals, sizes, threshold: float, small: int) -> list[list[int]]:
    """As agglomerate by average linkage, from the summed unit vectors of items in id order, without a matrix of all pairs.

    While more than `small` clusters are left, all that are each other's best are merged, as _average_rounds does.
    """
    import numpy as np

    totals, sizes, members = np.array(totals, float), np.array(sizes, float), [[i] for i in range(len(sizes))]
    while len(sizes) > small:
        means = totals / sizes[:, None]
        best = np.full(len(sizes), -1)
        for i in range(0, len(sizes), 512):
            scores = means[i : i + 512] @ means.T
            inside = np.arange(len(scores))
            scores[inside, i + inside] = -np.inf
            top = rounded(scores.max(axis=1), DIGITS)
            first = (scores >= (top - 0.5 * 10.0**-DIGITS)[:, None]).argmax(axis=1)
            best[i : i + 512] = np.where(top >= threshold - 10.0**-DIGITS, first, -1)
        keep = np.flatnonzero((best >= 0) & (best[best] == np.arange(len(best))) & (np.arange(len(best)) < best))
        if not len(keep):
            return sorted(map(sorted, members))
        gone = best[keep]
        totals[keep] += totals[gone]
        sizes[keep] += sizes[gone]
        for a, b in zip(keep.tolist(), gone.tolist(), strict=True):
            members[a] += members[b]
        left = np.delete(np.arange(len(sizes)), gone)
        totals, sizes, members = totals[left], sizes[left], [members[i] for i in left.tolist()]
    means = totals / sizes[:, None]
    return sorted(sorted(x for i in c for x in members[i]) for c in agglomerate(means @ means.T, threshold, sizes=sizes))


def least(rows, starts):
    """The least of each column over each run of rows; runs begin at `starts`."""
    import numpy as np

    sizes = np.diff(np.append(starts, len(rows)))
    order = np.argsort(-sizes, kind="stable")
    out, more = rows[starts], np.sort(sizes)
    for r in range(1, int(sizes.max())):
        longer = order[: len(sizes) - int(np.searchsorted(more, r, "right"))]
        if len(longer) < 4:
            for i in longer.tolist():
                out[i] = rows[starts[i] : starts[i] + sizes[i]].min(axis=0)
            break
        out[longer] = np.minimum(out[longer], rows[starts[longer] + r])
    return out


def nearest_clusters(ours, our_ids, theirs, their_ids):
    """(clusters, others, scores): for each cluster of `ours` the other one of `theirs` with the largest least similarity of members, the
    smaller id among equal ones. Unit vectors with the ids of their clusters, in order of these; scores are rounded.

    A block of STEP vectors meets all of theirs at a time.
    """
    import numpy as np

    def heads(ids):
        return np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))

    begins, starts = heads(our_ids), heads(their_ids)
    ends, ids, known = np.append(begins[1:], len(ours)), our_ids[begins], their_ids[starts]
    others, top, i = ids.copy(), np.full(len(ids), -np.inf), 0
    while i < len(ids):
        # Whole clusters; one of over STEP vectors meets them in several blocks.
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + STEP, "right")))
        scores = None
        for k in range(begins[i], ends[j - 1], STEP):
            met = least(theirs @ ours[k : min(k + STEP, ends[j - 1])].T, starts)
            met = least(np.ascontiguousarray(met.T), begins[i:j] - begins[i])
            scores = met if scores is None else np.minimum(scores, met)
        at = np.minimum(np.searchsorted(known, ids[i:j]), len(known) - 1)
        itself = np.flatnonzero(known[at] == ids[i:j])
        scores[itself, at[itself]] = -np.inf
        top[i:j] = rounded(np.minimum(scores.max(axis=1), 1), DIGITS)
        others[i:j] = known[(scores >= top[i:j, None] - 0.5 * 10.0**-DIGITS).argmax(axis=1)]
        i = j
    return ids, others, top


def complete_rounds(units, threshold: float, own=None):
    """The cluster of each item by complete linkage, from unit vectors, without a matrix of all pairs; `own`: the clusters to begin with.

    All clusters that are each other's best are merged in a round. Merges bring no cluster nearer to a third, so a best stays one
    until it merges, and a cluster without a partner is done.
    """
    import numpy as np

    own = np.arange(len(units)) if own is None else np.array(own)
    asked, none = -2, -1
    best = np.full(len(units), asked)
    while True:
        order = np.argsort(own, kind="stable")
        order = order[best[own[order]] != none]
        again = order[best[own[order]] == asked]
        if len(again):
            ids, others, top = nearest_clusters(units[again], own[again], units[order], own[order])
            best[ids] = np.where(top >= threshold - 10.0**-DIGITS, others, none)
        paired = np.unique(own[order])
        paired = paired[best[paired] > paired]
        keep = paired[best[best[paired]] == paired]
        if not len(keep):
            return own
        gone, merged, to = best[keep], np.zeros(len(best), bool), np.arange(len(best))
        to[gone], merged[keep], merged[gone] = keep, True, True
        own = to[own]
        best[merged | ((best >= 0) & merged[best])] = asked


def complete_link_in_task(units, threshold: float, small: int) -> list[list[int]]:
    """As agglomerate by complete linkage, from unit vectors in id order; a matrix is held of at most `small` items."""
    import numpy as np

    if len(units) <= small:
        return agglomerate(units @ units.T, threshold, "complete")
    own = complete_rounds(units, threshold)
    order = np.argsort(own, kind="stable")
    return [c.tolist() for c in np.split(order, np.flatnonzero(np.diff(own[order])) + 1)]


def greedy_medoids(units, threshold: float) -> list[list[int]]:
    """Takes the most central remaining item with all that reach the threshold, again and again."""
    import numpy as np

    left, part, own, out = np.arange(len(units)), units, (units * units).sum(axis=1), []
    while len(left):
        means = (part @ part.sum(axis=0) - own) / max(1, len(left) - 1)
        middle = int(np.flatnonzero(means >= means.max() - 1e-12)[0])
        near = np.clip(part @ part[middle], -1, 1) >= threshold
        near[middle] = True
        out.append(left[near].tolist())
        left, part, own = left[~near], part[~near], own[~near]
    return out


def _nodes(rows: DataFrame, merge_equal: bool) -> tuple[DataFrame, DataFrame]:
    """(issue_type, node, total, n) and (issue_type, report_id, node): rows with one vector form one node, zero vectors stay apart."""
    unit = rows.select("issue_type", "report_id", _unit("vec").alias("unit"))
    zero = ~F.exists("unit", lambda x: x != 0)
    same = [F.col("issue_type"), F.col("unit"), F.when(zero | F.lit(not merge_equal), F.col("report_id"))]
    least = unit.groupBy(*(c.alias(f"k{i}") for i, c in enumerate(same))).agg(F.min("report_id").alias("node"), F.count("*").alias("n"))
    nodes = checkpoint(least.select(F.col("k0").alias("issue_type"), "node", F.col("k1").alias("unit"), F.col("n").cast("double").alias("n"), F.col("k2").alias("apart")))
    keyed = unit.withColumn("apart", same[2])
    met = keyed.join(nodes.drop("n"), [keyed["issue_type"] == nodes["issue_type"], keyed["unit"] == nodes["unit"], keyed["apart"].eqNullSafe(nodes["apart"])])
    members = met.select(keyed["issue_type"], "report_id", "node")
    scaled = F.transform("unit", lambda x: x * F.col("n"))
    return nodes.select("issue_type", "node", scaled.alias("total"), "n"), members


def _large(nodes: DataFrame, small: int) -> DataFrame:
    return nodes.groupBy("issue_type").count().filter(F.col("count") > small).select("issue_type")


def _mutual(best: DataFrame) -> DataFrame:
    """(issue_type, keep, gone): pairs that are each other's best; best: issue_type, node, other."""
    other = best.select("issue_type", F.col("node").alias("other"), F.col("other").alias("node"))
    return best.join(other, ["issue_type", "node", "other"]).filter("node < other").select("issue_type", F.col("node").alias("keep"), F.col("other").alias("gone"))


def _best(offers: DataFrame) -> DataFrame:
    """The best offer (score, then smaller other) of each node; offers: issue_type, node, other, score."""
    place = F.max_by("other", F.struct("score", -F.col("other")))
    return offers.groupBy("issue_type", "node").agg(place.alias("other"))


def _moved(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """rows with `column` following the merges."""
    to = merges.select("issue_type", F.col("gone").alias(column), "keep")
    return rows.join(to, ["issue_type", column], "left").withColumn(column, F.coalesce("keep", column)).drop("keep")


def _average_offers(nodes: DataFrame, threshold: float) -> DataFrame:
    """Each node's best partner in each block, by mean similarity, where it reaches the threshold."""
    kind = nodes.schema["node"].dataType.simpleString()

    def compare(left, right, same):
        import numpy as np
        import pyarrow as pa

        def totals(table):
            return np.concatenate([c.flatten().to_numpy() for c in table.column("total").chunks]).reshape(table.num_rows, -1)

        order = [np.argsort(t.column("node").to_numpy()) for t in (left, right)]
        a, b = left.take(pa.array(order[0])), right.take(pa.array(order[1]))
        scores = totals(a) @ totals(b).T / (a.column("n").to_numpy()[:, None] * b.column("n").to_numpy())
        scores = rounded(scores, DIGITS)
        if same:
            np.fill_diagonal(scores, -np.inf)
        out = []
        for mine, theirs, s in ((a, b, scores),) if same else ((a, b, scores), (b, a, scores.T)):
            at = s.argmax(axis=1)
            value = s[np.arange(len(s)), at]
            keep = np.flatnonzero(value >= threshold - 10.0**-DIGITS)
            ids, others = mine.column("node").take(pa.array(keep)), theirs.column("node").take(pa.array(at[keep]))
            out.append(pa.table([mine.column("issue_type").take(pa.array(keep)), ids, others, pa.array(value[keep])], ["issue_type", "node", "other", "score"]))
        return pa.concat_tables(out)

    return pairwise(nodes, ["issue_type"], "node", compare, f"issue_type string, node {kind}, other {kind}, score double")


def _average_rounds(nodes: DataFrame, threshold: float, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Merges in the issue types of more than `small` nodes; the nodes left, and (issue_type, node, final) of the merged ones."""
    final = None
    while True:
        large = _large(nodes, small)
        merges = stored(_mutual(_best(_average_offers(nodes.join(large, "issue_type", "left_semi"), threshold))))
        if merges.isEmpty():
            return nodes, final
        step = merges.select("issue_type", F.col("gone").alias("node"), F.col("keep").alias("final"))
        if final is None:
            final = step
        else:
            final = _moved(final, merges, "final").unionByName(step)
        final = stored(final)
        moved = _moved(nodes, merges, "node")
        pairs = moved.groupBy("issue_type", "node").agg(F.collect_list("total").alias("totals"), F.sum("n").alias("n"))  # two at most
        total = F.when(F.size("totals") == 1, F.col("totals")[0]).otherwise(F.zip_with(F.col("totals")[0], F.col("totals")[1], lambda x, y: x + y))
        nodes = stored(pairs.select("issue_type", "node", total.alias("total"), "n"))


def _complete_offers(asked: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The best partner in each block, by least similarity, of each cluster of asked (issue_type, cluster, total), where it reaches the threshold."""
    kind = rows.schema["cluster"].dataType.simpleString()

    def compare(left, right):
        import numpy as np
        import pyarrow as pa

        sides = []
        for table in (left, right):
            ids = table.column("row_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            sides += [matrix(table, "total")[order], ids[order]]
        found = left.num_rows and right.num_rows
        ids, others, score = nearest_clusters(*sides) if found else (sides[1][:0], sides[3][:0], np.zeros(0))
        keep = np.flatnonzero(score >= threshold - 10.0**-DIGITS)
        return pa.table([left.column("issue_type").take(pa.array([0] * len(keep), pa.int64())), pa.array(ids[keep]), pa.array(others[keep]), pa.array(score[keep])], ["issue_type", "node", "other", "score"])

    wanted = ["issue_type", "cluster", "total"]
    left, right = asked.select(*wanted).withColumnRenamed("cluster", "ours"), rows.select(*wanted).withColumnRenamed("cluster", "theirs")
    return bipartite(left, right, ["issue_type"], "ours", "theirs", compare, f"issue_type string, node {kind}, other {kind}, score double", MEETING)


def _complete_rounds(nodes: DataFrame, threshold: float, small: int) -> tuple[DataFrame, DataFrame | None]:
    """As _average_rounds for complete linkage, but to the end: a cluster is the vectors of its nodes, and no pair is kept but a cluster's best.

    A cluster without a partner will never have one and leaves; one is compared again if its best has merged. A type ends in
    one task once at most `small` vectors are left of it.
    """
    large = stored(_large(nodes, small))
    rows = stored(nodes.join(F.broadcast(large), "issue_type", "left_semi").select("issue_type", "node", "total", F.col("node").alias("cluster")))
    best, done = None, []

    def without(table: DataFrame, types: DataFrame) -> DataFrame:
        return table.join(F.broadcast(types), "issue_type", "left_anti")

    while not rows.isEmpty():
        fits = stored(rows.groupBy("issue_type").count().filter(F.col("count") <= small).select("issue_type"))
        if not fits.isEmpty():
            done.append(stored(_ended(rows.join(F.broadcast(fits), "issue_type", "left_semi"), threshold)))
            rows, best = stored(without(rows, fits)), best if best is None else stored(without(best, fits))
        asked = rows if best is None else rows.join(best.select("issue_type", F.col("node").alias("cluster")), ["issue_type", "cluster"], "left_anti")
        found = _best(_complete_offers(asked, rows, threshold))
        held, best = best, stored(found if best is None else best.unionByName(found))
        if held is not None:
            release(held)
        merges = stored(_mutual(best))
        ends = rows.join(best.select("issue_type", F.col("node").alias("cluster")), ["issue_type", "cluster"], "left_anti") if not merges.isEmpty() else rows
        done.append(stored(ends.select("issue_type", "node", F.col("cluster").alias("final"))))
        if merges.isEmpty():
            break
        left = rows.join(best.select("issue_type", F.col("node").alias("cluster")), ["issue_type", "cluster"], "left_semi")
        held, rows = rows, stored(_moved(left, merges, "cluster"))
        release(held)
        merged = merges.select("issue_type", F.explode(F.array("keep", "gone")).alias("node"))
        held, best = best, stored(best.join(merged, ["issue_type", "node"], "left_anti").join(merged.withColumnRenamed("node", "other"), ["issue_type", "other"], "left_anti"))
        release(held)
        release(merges)
    return nodes.join(F.broadcast(large), "issue_type", "left_anti"), stored(reduce(DataFrame.unionByName, done))


def _ended(rows: DataFrame, threshold: float) -> DataFrame:
    """(issue_type, node, final) of the clusters that complete linkage makes of the clusters of rows, one task an issue type."""
    kind = rows.schema["node"].dataType.simpleString()

    def run(table):
        import numpy as np
        import pyarrow as pa

        nodes, clusters = table.column("node").to_numpy(), table.column("cluster").to_numpy()
        ids, own = np.unique(clusters, return_inverse=True)
        final = ids[complete_rounds(matrix(table, "total"), threshold, own)]
        return pa.table([table.column("issue_type"), pa.array(nodes), pa.array(final)], ["issue_type", "node", "final"])

    return _apart(rows.select("issue_type", "node", "total", "cluster")).groupBy("issue_type").applyInArrow(run, f"issue_type string, node {kind}, final {kind}")


def _apart(rows: DataFrame) -> DataFrame:
    """rows dealt by ranges of types, as rows are few and their work is not: a type over a share's rows has a task of its own."""
    return rows.repartitionByRange(max(SHARES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "issue_type")


def _in_task(nodes: DataFrame, find) -> DataFrame:
    """(issue_type, node, final) by find(unit vectors, sizes) -> clusters, one task an issue type; final: a cluster's smallest node."""
    kind = nodes.schema["node"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("node").reset_index(drop=True)
        totals, sizes = np.array(group["total"].tolist(), float), group["n"].to_numpy()
        ids, out = group["node"].tolist(), []
        for cluster in find(totals / sizes[:, None], sizes):
            out += [(group["issue_type"][0], ids[i], ids[min(cluster)]) for i in cluster]
        return pd.DataFrame(out, columns=["issue_type", "node", "final"])

    return _apart(nodes).groupBy("issue_type").applyInPandas(run, f"issue_type string, node {kind}, final {kind}")


def _clusters(rows: DataFrame, rounds, find, merge_equal: bool, small: int) -> DataFrame:
    """(issue_type, report_id, representative_id, similarity): rounds while an issue type is large, then one task each."""
    wanted = rows.select("issue_type", "report_id", "vec")
    alone = F.col("issue_type").isin(*EXCLUDED_TYPES)
    grouped = wanted.filter(~alone)
    nodes, members = _nodes(grouped, merge_equal)
    left, done = (nodes, None) if _large(nodes, small).isEmpty() else rounds(nodes, small)
    still_large = _large(left, small)
    finished = left.join(still_large, "issue_type", "left_semi").select("issue_type", "node", F.col("node").alias("final"))
    last = checkpoint(_in_task(left.join(still_large, "issue_type", "left_anti"), find).unionByName(finished))
    members = members.join(last, ["issue_type", "node"], "left") if done is None else (
        members.join(done.withColumnRenamed("final", "mid"), ["issue_type", "node"], "left")
        .withColumn("node", F.coalesce("mid", "node"))
        .drop("mid")
        .join(last, ["issue_type", "node"], "left")
    )
    members = checkpoint(members.select("issue_type", "report_id", F.coalesce("final", "node").alias("cluster")))
    named = grouped.join(members, ["issue_type", "report_id"])
    key = F.struct("issue_type", "cluster")
    middle = medoid(named.select(key.alias("signal_id"), F.col("report_id").alias("member_id"), "vec"), with_self=False, digits=12)
    middle = middle.select("signal_id.issue_type", "signal_id.cluster", F.col("member_id").alias("representative_id"))
    middle = checkpoint(middle.join(grouped.select("issue_type", F.col("report_id").alias("representative_id"), F.col("vec").alias("middle")), ["issue_type", "representative_id"]))
    score = F.when(F.col("report_id") == F.col("representative_id"), 1.0).otherwise(cosine(F.col("vec"), F.col("middle")))
    found = named.join(middle, ["issue_type", "cluster"]).select("issue_type", "report_id", "representative_id", score.alias("similarity"))
    single = wanted.filter(alone).select("issue_type", "report_id", F.col("report_id").alias("representative_id"), F.lit(1.0).alias("similarity"))
    return found.unionByName(single)


def batch_clusters(rows: DataFrame, threshold: float = BATCH_THRESHOLD, small: int = HELD) -> DataFrame:
    """(issue_type, report_id, representative_id, similarity) of average-linkage clusters; independent of row order."""
    return _clusters(
        rows,
        lambda nodes, limit: _average_rounds(nodes, threshold, limit),
        lambda units, sizes: average_link(units * sizes[:, None], sizes, threshold, min(small, SMALL)),
        threshold <= 1,
        small,
    )


def complete_link(rows: DataFrame, threshold: float, small: int = HELD) -> DataFrame:
    """As batch_clusters by complete linkage."""
    return _clusters(
        rows,
        lambda nodes, limit: _complete_rounds(nodes, threshold, limit),
        lambda units, sizes: complete_link_in_task(units, threshold, min(small, SMALL)),
        threshold <= 1,
        small,
    )


def _greedy_rounds(nodes: DataFrame, threshold: float, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Takes one medoid of each issue type of more than `small` nodes a round."""
    done = None
    left = nodes
    while not (large := _large(left, small)).isEmpty():
        inside = left.join(large, "issue_type", "left_semi").select(F.col("issue_type").alias("signal_id"), F.col("node").alias("member_id"), F.col("total").alias("vec"))
        middle = medoid(inside, with_self=False, digits=12).select(F.col("signal_id").alias("issue_type"), F.col("member_id").alias("final"))
        middle = middle.join(left.select("issue_type", F.col("node").alias("final"), F.col("total").alias("middle")), ["issue_type", "final"])
        near = (F.col("node") == F.col("final")) | (cosine(F.col("total"), F.col("middle")) >= threshold)
        taken = stored(left.join(middle, "issue_type").filter(near).select("issue_type", "node", "final"))
        done = taken if done is None else stored(done.unionByName(taken))
        left = stored(left.join(taken, ["issue_type", "node"], "left_anti"))
    return left, done


def medoid_greedy(rows: DataFrame, threshold: float, small: int = HELD) -> DataFrame:
    """As batch_clusters, for the clusters that greedy_medoids takes."""
    return _clusters(
        rows, lambda nodes, limit: _greedy_rounds(nodes, threshold, limit), lambda units, sizes: greedy_medoids(units, threshold), False, small
    )


MEMBERS = "signal_id long, report_id long, similarity double, status string, raw_report_count long, unique_sessions long, first_at long, last_at long, representative_id long"


def member_rows(clusters) -> list[tuple]:
    out = []
    for c in clusters:
        state = (c.status, c.raw, c.sessions, c.first, c.last, c.representative)
        out += [(c.id, m[0], m[4], *state) for m in c.members]
    return out


def islands(reports: DataFrame, keys: list[str], window: float) -> DataFrame:
    """Adds island: rows of one gate that no gap over the window (in seconds) divides. Different islands never share a cluster."""
    order = W.partitionBy(*keys).orderBy("at", "report_id")
    new = F.coalesce(F.col("at") - F.lag("at").over(order) > window * 1_000_000, F.lit(True)).cast("long")
    return reports.withColumn("_new", new).withColumn("island", F.sum("_new").over(order)).drop("_new")


def usable(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The columns that incremental clustering reads; rows without id, time or vector take no part."""
    rows = known_filters(reports.withColumn("at", micros("received_at")))
    rows = rows.select(*keys, "report_id", "session_id", "at", "vec", "submission_filter", "error_filter")
    return rows.dropna(subset=["report_id", "at", "vec"])


def online_clusters(reports: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """MEMBERS rows after all reports came in order of (received_at, report_id).

    reports: keys, report_id, session_id, received_at, vec, submission_status, error_code; of rows repeating a report_id
    within a window one counts. A gate's reports stream through one task, which holds the clusters of the last window alone.
    """
    rows = islands(usable(reports, keys), keys, policy.window)
    group = [*keys, "island"]
    shares = max(ISLAND_SHARES, int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(shares, *group).sortWithinPartitions(*group, "at", "report_id")

    def run(batches):
        import pyarrow as pa

        gate, at, out = None, None, []

        def emit(clusters):
            out.extend(member_rows(clusters))

        def flush():
            names = [f.split()[0] for f in MEMBERS.split(", ")]
            kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in MEMBERS.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return batch

        seen: dict = {}  # ids of the last window with their times
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            heads = zip(*(columns[batch.schema.get_field_index(k)] for k in group), strict=True)
            names = ("report_id", "session_id", "at", "vec", "submission_filter", "error_filter")
            for head, row in zip(heads, zip(*(columns[batch.schema.get_field_index(k)] for k in names), strict=True), strict=True):
                if head != at:
                    if gate is not None:
                        emit(gate.clusters.values())
                    gate, at, seen = IncrementalGate(policy), head, {}
                if seen.get(row[0], row[2] - gate.window - 1) >= row[2] - gate.window:
                    continue
                seen[row[0]] = row[2]
                gate.add(*row)
            if gate is not None:
                emit(gate.passed())
                seen = {k: t for k, t in seen.items() if t >= gate.latest - gate.window}
            if len(out) > 20_000:
                yield flush()
        if gate is not None:
            emit(gate.clusters.values())
        yield flush()

    return dealt.mapInArrow(run, MEMBERS)


class Arrivals:
    """The evaluator's clustering by arrival: join the first best cluster by mean similarity, else open one; optionally merge.

    Clusters are sums of unit vectors with their members' ids. After an arrival only pairs of the changed cluster can have
    come over the threshold, and the first of them in order is merged.
    """

    def __init__(self, threshold: float, merging: bool):
        self.threshold, self.merging = threshold, merging
        self.members: list[list] = []
        self.sums = self.sizes = None

    def add(self, report_id, vector) -> None:
        import numpy as np

        v = np.asarray(vector, float)
        size = float(np.linalg.norm(v))
        unit = v / size if size else v
        n = len(self.members)
        if self.sums is None:
            self.sums, self.sizes = np.zeros((16, len(unit))), np.ones(16)
        elif n == len(self.sums):
            self.sums, self.sizes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.sizes, np.ones(n)])
        scores = self.sums[:n] @ unit / self.sizes[:n]
        at = int(scores.argmax()) if n else -1
        if n and scores[at] >= self.threshold:
            self.members[at].append(report_id)
            self.sums[at] += unit
            self.sizes[at] += 1
        else:
            at = n
            self.members.append([report_id])
            self.sums[n], self.sizes[n] = unit, 1
        while self.merging:
            n = len(self.members)
            scores = self.sums[:n] @ self.sums[at] / (self.sizes[:n] * self.sizes[at])
            scores[at] = -np.inf
            near = np.flatnonzero(scores >= self.threshold)
            if not len(near):
                return
            a, b = sorted((at, int(near[0])))
            self.members[a] += self.members.pop(b)
            self.sums[a] += self.sums[b]
            self.sizes[a] += self.sizes[b]
            self.sums[b : n - 1], self.sizes[b : n - 1] = self.sums[b + 1 : n].copy(), self.sizes[b + 1 : n].copy()
            at = a


def threshold_parts(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(report_id, part), materialised, for rows (keys, report_id, vec) that are near another row of equal keys; part: the smallest id.

    Near is a cosine of the threshold, less a margin for rounding. A mean that reaches the threshold has a pair that does, so
    clusters that join or merge by means never leave a part. Pairs are compared by blocks and only links that join what is
    still apart leave a task: first inside blocks, then, by the parts so far, across all pairs of blocks.
    """
    kind = rows.schema["report_id"].dataType.simpleString()
    low = threshold - NEAR

    def compare(left, right, same):
        import numpy as np
        import pyarrow as pa

        near = matrix(left, "vec") @ matrix(right, "vec").T >= low
        if same:
            np.fill_diagonal(near, False)
        names, code = np.unique(np.concatenate([left.column("root").to_numpy(), right.column("root").to_numpy()]), return_inverse=True)
        a, b = code[: left.num_rows], code[left.num_rows :]
        parent, links = list(range(len(names))), []

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in np.flatnonzero(near.any(axis=1)).tolist():
            for j in np.unique(b[near[i]]).tolist():
                x, y = find(a[i]), find(j)
                if x != y:
                    parent[y] = x
                    links.append((names[x], names[y]))
        found = np.array(links, names.dtype).reshape(-1, 2)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])

    own = rows.select(*keys, "report_id", "vec").withColumn("root", F.col("report_id"))
    schema = f"x {kind}, y {kind}"
    cut = checkpoint(placed(own, keys, "report_id"))
    inside = cut.groupBy(*keys, "block").applyInArrow(lambda table: compare(table, table, True), schema)
    first = checkpoint(components(inside))
    if cut.filter("blocks > 1").isEmpty():
        return first.select(F.col("node").alias("report_id"), F.col("root").alias("part"))
    many = cut.filter("blocks > 1").drop("root").join(first.withColumnRenamed("node", "report_id"), "report_id", "left").withColumn("root", F.coalesce("root", "report_id"))
    across = checkpoint(components(pairwise(many.drop("block", "blocks"), keys, "report_id", compare, schema)))
    joined = first.join(across.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    every = joined.unionByName(across.join(first, "node", "left_anti"))
    return checkpoint(every.select(F.col("node").alias("report_id"), F.col("root").alias("part")))


def arrivals(rows: DataFrame, threshold: float, orders: int = 12, merging: bool = False, parts: DataFrame | None = None) -> DataFrame:
    """(issue_type, order_id, report_id, cluster): the given, the reversed and shuffled arrival orders; cluster: its smallest id.

    Each order of a part of an issue type (`threshold_parts`, worked out if not given) is a sorted stream through one task;
    reports that are near no other are clusters of their own.
    """
    parts = threshold_parts(rows, ["issue_type"], threshold) if parts is None else parts
    kind = rows.schema["report_id"].dataType.simpleString()
    given = F.when(F.col("order_id") == 0, F.col("report_id")).when(F.col("order_id") == 1, -F.col("report_id")).otherwise(F.xxhash64("order_id", "report_id"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("order_id")
    found = rows.select("issue_type", "report_id", "vec").join(parts, "report_id", "left")
    alone = found.filter("part IS NULL").select("issue_type", numbers, "report_id", F.col("report_id").alias("cluster"))
    numbered = found.filter("part IS NOT NULL").select("issue_type", "part", "report_id", "vec", numbers)
    group = ["issue_type", "order_id", "part"]
    dealt = numbered.withColumn("place", given).repartition(*group).sortWithinPartitions(*group, "place", "report_id")

    def run(batches):
        import pyarrow as pa

        state, at, types = None, None, None

        def clusters():
            ids = [(x, min(c)) for c in state.members for x in c]
            for i in range(0, len(ids), 20_000):
                part = ids[i : i + 20_000]
                columns = [pa.array([at[0]] * len(part), pa.string()), pa.array([at[1]] * len(part), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in part], types), pa.array([c for _, c in part], types)], ["issue_type", "order_id", "report_id", "cluster"])

        for batch in batches:
            types = batch.schema.field("report_id").type
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*group, "report_id", "vec")}
            for issue, order, part, report, vec in zip(*columns.values(), strict=True):
                if (issue, order, part) != at:
                    if state is not None:
                        yield from clusters()
                    state, at = Arrivals(threshold, merging), (issue, order, part)
                state.add(report, vec)
        if state is not None:
            yield from clusters()

    return dealt.mapInArrow(run, f"issue_type string, order_id int, report_id {kind}, cluster {kind}").unionByName(alone)


def part_sizes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(issue_type, reports, parts, largest): how far the threshold graph splits each type; a report that is near none is a part."""
    counted = rows.select("issue_type", "report_id").join(parts, "report_id", "left").groupBy("issue_type", F.coalesce("part", "report_id").alias("part")).agg(F.count("*").alias("n"))
    return counted.groupBy("issue_type").agg(F.sum("n").alias("reports"), F.count("*").alias("parts"), F.max("n").alias("largest"))


def order_stability(rows: DataFrame, threshold: float, orders: int = 12, merging: bool = False, parts: DataFrame | None = None) -> DataFrame:
    """(issue_type, order_id, clusters, same_as_first): whether an arrival order leads to the clusters of the given one."""
    each = arrivals(rows, threshold, orders, merging, parts)
    in_first = F.max(F.when(F.col("order_id") == 0, F.col("cluster"))).alias("first")
    entries = F.collect_list(F.struct("order_id", "cluster")).alias("entries")  # one an order
    by_report = each.groupBy("issue_type", "report_id").agg(in_first, entries).select("issue_type", "report_id", "first", F.inline("entries"))
    return by_report.groupBy("issue_type", "order_id").agg(
        F.sum((F.col("report_id") == F.col("cluster")).cast("int")).cast("int").alias("clusters"), F.every(F.col("cluster") == F.col("first")).alias("same_as_first")
    )
