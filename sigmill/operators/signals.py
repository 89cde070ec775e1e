"""Evidence, baselines, linkage scores, medoids, states and lists of incident signals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .blocks import bipartite, matrix, pairwise_ranges, rounded
from .decisions import audit_events, closed, judge_merges
from .gates import is_public, micros
from .shared import checkpoint

OPEN = ("CANDIDATE", "SIGNAL_DETECTED")
NEVER = "INSUFFICIENT_HISTORY"
#: Ids of a range, about: fewer than a power of two, so that a file needs 13 bits for each.
RANGE = 7800
#: Rows of a strip of similarities, pairs put in order at once, pairs of a batch.
STRIP, BAND, BATCH = 256, 1 << 21, 1 << 18
#: Pairs of a similarity from which on the order of similarities needs fewer bytes than that of ids.
RECUR = 3


def interval(seconds: int | Column) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds) if isinstance(seconds, int) else seconds)


def in_evidence_window(members: DataFrame, window: int) -> DataFrame:
    """Members received in [last - window, last] of their signal, with last."""
    last = F.max("received_at").over(W.partitionBy("signal_id"))
    return members.withColumn("last", last).filter(F.col("received_at") >= F.col("last") - interval(window))


def evidence(members: DataFrame, window: int, min_sessions: int, review_sessions: int) -> DataFrame:
    """One row a signal: counts and bounds of its evidence window, review priority and state as a new candidate."""
    counted = in_evidence_window(members, window).groupBy("signal_id").agg(
        F.count("report_id").alias("raw_report_count"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.min("received_at").alias("first_report_at"),
        F.max("received_at").alias("last_report_at"),
        F.max("purge_at").alias("purge_at"),
    )
    return counted.withColumn("review_priority", F.col("unique_sessions") >= review_sessions).withColumn(
        "status", next_state(F.lit("CANDIDATE"), F.col("unique_sessions"), F.lit(min_sessions), F.lit(False))
    )


def next_state(status: Column, sessions: Column, least: Column, after_deletion: Column) -> Column:
    """Too little evidence after a deletion closes; otherwise candidates and detected signals follow the count."""
    return (
        F.when(after_deletion & (sessions < least), "CLOSED")
        .when((status == "CANDIDATE") & (sessions >= least), "SIGNAL_DETECTED")
        .when((status == "SIGNAL_DETECTED") & (sessions < least), "CANDIDATE")
        .otherwise(status)
    )


def hourly_volume(members: DataFrame, signals: DataFrame, window: int) -> DataFrame:
    """(bucket_start, raw_report_count, unique_sessions) over the signals' trailing windows."""
    inside = members.join(signals.select("signal_id", F.col("last_report_at").alias("last")), "signal_id").filter(
        (F.col("received_at") >= F.col("last") - interval(window)) & (F.col("received_at") <= F.col("last"))
    )
    hour = F.date_trunc("hour", "received_at").cast("timestamp_ntz")
    return inside.groupBy(hour.alias("bucket_start")).agg(
        F.count("report_id").alias("raw_report_count"), F.count_distinct("session_id").alias("unique_sessions")
    )


def baseline(members: DataFrame, signals: DataFrame, window: int, policy_created_at: Column) -> DataFrame:
    """(signal_id, unique_sessions, previous_sessions, baseline_status, baseline_ratio).

    The previous window is [last - 2 window, last - window); a policy younger than its begin has no history.
    """
    last = F.col("last_report_at")
    bounds = signals.select("signal_id", "unique_sessions", "last_report_at")
    before = members.join(bounds.select("signal_id", "last_report_at"), "signal_id").filter(
        (F.col("received_at") >= last - interval(2 * window)) & (F.col("received_at") < last - interval(window))
    )
    counts = before.groupBy("signal_id").agg(F.count_distinct("session_id").alias("previous_sessions"))
    joined = bounds.join(counts, "signal_id", "left").withColumn("previous_sessions", F.coalesce("previous_sessions", F.lit(0)))
    status = F.when(policy_created_at > last - interval(2 * window), NEVER).when(F.col("previous_sessions") == 0, "ZERO_BASELINE").otherwise("AVAILABLE")
    ratio = F.when(F.col("baseline_status") == "AVAILABLE", F.col("unique_sessions") / F.col("previous_sessions"))
    out = joined.withColumn("baseline_status", status).withColumn("baseline_ratio", ratio)
    return out.select("signal_id", "unique_sessions", "previous_sessions", "baseline_status", "baseline_ratio")


def dashboard_baseline(baselines: DataFrame) -> DataFrame:
    """One row for a page of signals; any without history, or none at all, leaves the page without."""
    total = baselines.agg(
        F.count_if(F.col("baseline_status") == NEVER).alias("unknown"),
        F.count("*").alias("n"),
        F.sum("unique_sessions").alias("now"),
        F.sum("previous_sessions").alias("before"),
    )
    status = F.when((F.col("n") == 0) | (F.col("unknown") > 0), NEVER).when(F.col("before") == 0, "ZERO_BASELINE").otherwise("AVAILABLE")
    return total.withColumn("baseline_status", status).select(
        "baseline_status", F.when(F.col("baseline_status") == "AVAILABLE", F.col("now") / F.col("before")).alias("baseline_ratio")
    )


def _unit(vec: str) -> Column:
    size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    # In an array of its own the size is worked out once a vector; within the inner lambda it would be for each component.
    return F.transform(F.array(size), lambda s: F.transform(vec, lambda x: F.when(s == 0, 0.0).otherwise(x / s)))[0]


def _sums(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, total): the sum of the unit vectors of each key, added up component by component before rows meet."""
    parts = rows.select(*keys, F.posexplode(_unit(vec)).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    entries = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(*keys).agg(F.transform(entries, lambda e: e["x"]).alias("total"))


def linkage_scores(candidates: DataFrame, members: DataFrame, keys: list[str], window: int | None = None) -> DataFrame:
    """(candidate_id, signal_id, similarity): mean cosine of each candidate with a signal's members in its window.

    candidates: keys, candidate_id, vec (and received_at); members: keys, signal_id, member_id, member_vec (and member_at).
    A candidate that is a member of a signal does not count itself. Without a window the mean is a dot product with the sum
    of the members' unit vectors, so no pairs are made; with one, candidates meet members of their own and the neighbouring
    stretches of time.
    """
    if window is not None:
        stretch = window * 1_000_000
        near = F.explode(F.sequence(F.floor(micros("received_at") / stretch) - 1, F.floor(micros("received_at") / stretch) + 1))
        met = candidates.withColumn("_stretch", near).join(members.withColumn("_stretch", F.floor(micros("member_at") / stretch)), [*keys, "_stretch"])
        met = met.filter((F.abs(micros("member_at") - micros("received_at")) <= stretch) & (F.col("member_id") != F.col("candidate_id")))
        return met.groupBy("candidate_id", "signal_id").agg(F.avg(cosine(F.col("vec"), F.col("member_vec"))).alias("similarity"))
    sums = _sums(members, [*keys, "signal_id"], "member_vec").join(members.groupBy(*keys, "signal_id").agg(F.count("*").alias("n")), [*keys, "signal_id"])
    own = candidates.select("candidate_id", *keys).join(
        members.select(F.col("member_id").alias("candidate_id"), *keys, "signal_id", F.lit(1).alias("own")), ["candidate_id", *keys]
    )
    unit = candidates.select("candidate_id", *keys, _unit("vec").alias("unit"))
    met = unit.join(sums, keys).join(own.drop(*keys), ["candidate_id", "signal_id"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    itself = F.when(F.col("own") == 1, F.when(F.exists("unit", lambda x: x != 0), 1.0).otherwise(0.0)).otherwise(0.0)
    whole = F.aggregate(F.zip_with("unit", "total", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.filter("n > own").select("candidate_id", "signal_id", ((whole - itself) / (F.col("n") - F.col("own"))).alias("similarity"))


def best_signal(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """The best score of each candidate, ties to the smaller signal; digits rounds before comparing."""
    value = F.col("similarity") if digits is None else F.round("similarity", digits)
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(value.desc(), "signal_id"))
    return scores.withColumn("similarity", value).withColumn("_place", place).filter("_place = 1").drop("_place")


def nearest_member(candidates: DataFrame, members: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(candidate_id, signal_id, member_id, similarity): the nearest member, ties to the smaller signal and member.

    A candidate is not its own member. Blocks of candidates meet blocks of members, and a task keeps the best of each candidate.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def compare(asked, found):
        import numpy as np
        import pyarrow as pa

        left, right = matrix(asked, "vec"), matrix(found, "vec")
        scores = rounded(np.clip(left @ right.T, -1, 1), digits)
        mine, theirs, signal = asked.column("row_id").to_pylist(), found.column("row_id").to_pylist(), found.column("signal_id").to_pylist()
        at = {x: j for j, x in enumerate(theirs)}
        for i, x in enumerate(mine):
            if x in at:
                scores[i, at[x]] = -np.inf
        order = sorted(range(len(theirs)), key=lambda j: (signal[j], theirs[j]))
        best = [order[j] for j in scores[:, order].argmax(axis=1)] if theirs else []
        rows = [(mine[i], signal[j], theirs[j], float(scores[i, j])) for i, j in enumerate(best) if scores[i, j] > -np.inf]
        names = ["candidate_id", "signal_id", "member_id", "similarity"]
        types = [asked.schema.field("row_id").type, found.schema.field("signal_id").type, found.schema.field("row_id").type, pa.float64()]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    left = candidates.select(*keys, "candidate_id", F.lit(None).cast(kinds["signal_id"]).alias("signal_id"), "vec")
    right = members.select(*keys, "member_id", "signal_id", F.col("member_vec").alias("vec"))
    schema = f"candidate_id {kinds['member_id']}, signal_id {kinds['signal_id']}, member_id {kinds['member_id']}, similarity double"
    met = bipartite(left, right, keys, "candidate_id", "member_id", compare, schema)
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.col("similarity").desc(), "signal_id", "member_id"))
    return met.withColumn("_place", place).filter("_place = 1").drop("_place")


def similarity_pairs(rows: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs with equal keys, left_id < right_id; rows: keys, row_id, vec.

    Null keys and ids equal nothing. A task has two ranges of ids. Where its similarities recur it gives its pairs in their order,
    nearest to zero first, else in that of ids: a file then holds either column in few bytes.
    """
    kind = rows.schema["row_id"].dataType.simpleString()
    scale = 10**digits
    nan, none = 2 * scale + 2, 2 * scale + 3
    shift = max(0, none.bit_length() - 22)

    def compare(left, right, same):
        import numpy as np

        left, right = left.sort_by("row_id"), right.sort_by("row_id")
        a, b = matrix(left, "vec"), matrix(right, "vec")
        if not len(a) or not len(b):
            return
        ids = [side.column("row_id").combine_chunks() for side in (left, right)]
        finite = np.isfinite(a).all() and np.isfinite(b).all()
        width = len(b).bit_length()
        bits = len(a).bit_length() + width

        def coded(scores):
            """Twice the size of a similarity in its last digit, and one more where its sign is negative, that of zero too."""
            negative, unknown = np.signbit(scores), False if finite else np.isnan(scores)
            np.minimum(np.abs(scores, out=scores), 1, out=scores)
            scores *= scale
            scores += 0.5
            if not finite:
                scores[unknown] = 0
            codes = scores.astype(np.int32 if none < 1 << 31 else np.int64)
            codes *= 2
            codes += negative
            if not finite:
                codes[unknown] = nan
            return codes

        strips, counts = [], np.zeros((none >> shift) + 1, np.int64)
        for first in range(0, len(a), STRIP):
            start = first if same else 0
            codes = coded(a[first : first + STRIP] @ b[start:].T)
            if same:
                codes[np.tri(*codes.shape, dtype=bool)] = none
            strips.append((first, start, codes))
            counts += np.bincount((codes[codes < none] if same else codes.ravel()) >> shift, minlength=len(counts))

        def batches(taken, low, high):
            parts = []
            for first, start, codes in taken:
                x = np.flatnonzero((codes >= low) & (codes < high))
                i = x // codes.shape[1]
                parts.append((codes.ravel()[x], (i + first << width) + (x - i * codes.shape[1]) + start))
            found, at = np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])
            if recur and (high - low).bit_length() + bits < 63:
                both = np.sort((found - low << bits) + at)
                found, at = (both >> bits) + low, both & (1 << bits) - 1
            elif recur:
                order = np.argsort(found, kind="stable")
                found, at = found[order], at[order]
            i, j = at >> width, at & (1 << width) - 1
            values = np.copysign((found >> 1) / scale, 0.5 - (found & 1))
            if not finite:
                values[found == nan] = np.nan
            for k in range(0, len(at), BATCH):
                piece = slice(k, k + BATCH)
                yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i[piece])), ids[1].take(pa.array(j[piece])), pa.array(values[piece])], ["a", "b", "similarity"])

        recur = np.count_nonzero(counts) * RECUR <= counts.sum()
        ends = np.unique(np.searchsorted(np.cumsum(counts), np.arange(BAND, counts.sum(), BAND)) + 1) if recur else np.array([], int)
        bounds = [0, *(ends[ends < len(counts)] << shift).tolist(), none]
        for low, high in zip(bounds, bounds[1:], strict=False):
            # A similarity of very many pairs goes strip by strip.
            whole = recur and counts[low >> shift : high >> shift].sum() <= 2 * BAND
            for taken in [strips] if whole else [[strip] for strip in strips]:
                yield from batches(taken, low, high)

    met = pairwise_ranges(rows.select(*keys, "row_id", "vec").dropna(subset=[*keys, "row_id"]), keys, "row_id", compare, f"a {kind}, b {kind}, similarity double", RANGE)
    return met.filter("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "similarity")


def _mean_cosines(vectors: DataFrame) -> DataFrame:
    """vectors with n, the size of the signal, whole, the sum of cosines to all its members, and own, the one to itself.

    With vectors of length one that sum is a dot product with the members' sum, so nothing is joined pairwise.
    """
    unit = vectors.withColumn("unit", _unit("vec")).withColumn("own", F.when(F.exists("unit", lambda x: x != 0), 1.0).otherwise(0.0))
    sums = _sums(vectors, ["signal_id"], "vec")
    counts = vectors.groupBy("signal_id").agg(F.count("*").alias("n"))
    whole = F.aggregate(F.zip_with("unit", "total", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return unit.join(sums, "signal_id").join(counts, "signal_id").withColumn("whole", whole).drop("unit", "total")


def _mean_of_others() -> Column:
    return F.when(F.col("n") == 1, 1.0).otherwise((F.col("whole") - F.col("own")) / (F.col("n") - 1))


def medoid(vectors: DataFrame, with_self: bool = True, digits: int | None = None) -> DataFrame:
    """(signal_id, member_id, score): the member with the largest mean cosine, ties to the smaller id.

    vectors: signal_id, member_id, vec. A zero vector has cosine 0 with all, itself
    included. Without the self pair the mean runs over the others, 1.0 for a lone member.
    """
    score = F.col("whole") / F.col("n") if with_self else _mean_of_others()
    scored = _mean_cosines(vectors).withColumn("score", score if digits is None else F.round(score, digits))
    place = F.row_number().over(W.partitionBy("signal_id").orderBy(F.col("score").desc(), "member_id"))
    return scored.withColumn("_place", place).filter("_place = 1").select("signal_id", "member_id", "score")


def text_medoid(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """(group_id, text): the text with the largest mean cosine to the group's others, ties to the largest text."""
    score = _mean_of_others() if digits is None else F.round(_mean_of_others(), digits)
    scored = _mean_cosines(rows.withColumnRenamed("group_id", "signal_id")).withColumn("score", score)
    return scored.groupBy(F.col("signal_id").alias("group_id")).agg(F.max(F.struct("score", "text"))["text"].alias("text"))


def group_mode(rows: DataFrame, order: str) -> DataFrame:
    """(group_id, issue_type): the commonest type of each group, ties to the one that came first by `order`."""
    counts = rows.groupBy("group_id", "issue_type").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(W.partitionBy("group_id").orderBy(F.col("n").desc(), "first", "issue_type"))
    return counts.withColumn("_place", place).filter("_place = 1").select("group_id", "issue_type")


def dashboard_items(signals: DataFrame, now: Column, window: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of public signals, latest first."""
    visible = signals.filter(is_public(F.col("status"), F.col("last_report_at"), F.lit(window), now))
    return visible.orderBy(F.col("last_report_at").desc(), "signal_id").offset(offset).limit(limit)


def operator_signals(signals: DataFrame, symptoms: DataFrame, now: Column, window: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of all signals with expiry, visibility and, where there is one, the representative's text."""
    shown = signals.join(symptoms, "representative_id", "left").withColumns(
        {
            "window_expires_at": F.col("last_report_at") + interval(window),
            "public_visible": is_public(F.col("status"), F.col("last_report_at"), F.lit(window), now),
        }
    )
    return shown.orderBy(F.col("last_report_at").desc(), "signal_id").offset(offset).limit(limit)


def mergeable(signals: DataFrame, locks: DataFrame) -> DataFrame:
    """Open, unofficial signals without a reviewer's lock."""
    return signals.filter(F.col("status").isin(*OPEN)).join(locks.select("signal_id"), "signal_id", "left_anti")


def merge(members: DataFrame, source: str, target: str) -> DataFrame:
    """Members after the source's went to the target; a report in both stays once, the target's row."""
    moved = members.withColumn("_moved", F.col("signal_id") == source).withColumn(
        "signal_id", F.when(F.col("signal_id") == source, F.lit(target)).otherwise(F.col("signal_id"))
    )
    place = F.row_number().over(W.partitionBy("signal_id", "report_id").orderBy("_moved"))
    return moved.withColumn("_place", place).filter("_place = 1").drop("_place", "_moved")


def split(members: DataFrame, chosen: DataFrame, source: str, new: str) -> DataFrame:
    """Members after the chosen reports of the source went to a new signal."""
    marked = members.join(chosen.select("report_id", F.lit(True).alias("_chosen")), "report_id", "left")
    go = (F.col("signal_id") == source) & F.coalesce("_chosen", F.lit(False))
    return marked.withColumn("signal_id", F.when(go, F.lit(new)).otherwise(F.col("signal_id"))).drop("_chosen")


def detach(members: DataFrame, gone: DataFrame, window: int, min_sessions: int, review_sessions: int) -> DataFrame:
    """Evidence of the touched signals after reports went: too little closes them, and a closed one has no bounds."""
    touched = members.join(gone.select("report_id"), "report_id", "left_semi").select("signal_id").distinct()
    left = members.join(gone.select("report_id"), "report_id", "left_anti")
    counted = touched.join(evidence(left, window, min_sessions, review_sessions).drop("status"), "signal_id", "left")
    counted = counted.fillna(0, ["raw_report_count", "unique_sessions"]).fillna(False, ["review_priority"])
    state = next_state(F.lit("SIGNAL_DETECTED"), F.col("unique_sessions"), F.lit(min_sessions), F.lit(True))
    return counted.withColumn("status", state).withColumn("closure_reason", F.when(F.col("status") == "CLOSED", "EVIDENCE_RECALCULATED"))


STATE = ("raw_report_count", "unique_sessions", "review_priority", "first_report_at", "last_report_at", "purge_at")


def _recalculated(
    signals: DataFrame, members: DataFrame, after_deletion: DataFrame, touched: DataFrame, window: int, least: int, review: int, vectors: DataFrame | None = None
) -> DataFrame:
    """signals with the evidence and state of the touched ones (signal_id, at) worked out anew; after_deletion: those that too little closes, at `at`.

    With vectors (report_id, member_id, vec) the medoid of the evidence window becomes the representative.
    """
    mine = members.join(touched, "signal_id", "left_semi")
    now = evidence(mine, window, least, review).drop("status").select("signal_id", *[F.col(c).alias(f"_{c}") for c in STATE])
    marked = (
        signals.join(now, "signal_id", "left")
        .join(touched.select("signal_id", F.col("at").alias("_at"), F.lit(True).alias("_touched")), "signal_id", "left")
        .join(after_deletion.select("signal_id", F.lit(True).alias("_deleted")), "signal_id", "left")
    )
    mine_now = F.coalesce("_touched", F.lit(False))
    count = F.coalesce("_unique_sessions", F.lit(0))
    state = next_state(F.col("status"), count, F.lit(least), F.coalesce("_deleted", F.lit(False)))
    none = {"raw_report_count": F.lit(0), "unique_sessions": F.lit(0), "review_priority": F.lit(False)}
    shut = mine_now & (F.col("status") != "CLOSED") & (state == "CLOSED")
    changed = {c: F.when(mine_now, F.coalesce(f"_{c}", none.get(c, F.col(c)))).otherwise(F.col(c)) for c in STATE}
    changed["status"] = F.when(mine_now, state).otherwise(F.col("status"))
    changed["closure_reason"] = F.when(shut, "EVIDENCE_RECALCULATED").otherwise(F.col("closure_reason"))
    if vectors is not None and "representative_id" in signals.columns:
        found = in_evidence_window(mine, window).join(vectors.select("report_id", "member_id", "vec"), "report_id").select("signal_id", "member_id", "vec")
        marked = marked.join(medoid(found, digits=9).select("signal_id", F.col("member_id").alias("_member")), "signal_id", "left")
        changed["representative_id"] = F.when(mine_now, F.col("_member")).otherwise(F.col("representative_id"))
    if "closed_at" in signals.columns:
        changed["closed_at"] = F.when(shut, F.col("_at")).otherwise(F.col("closed_at"))
    return marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in signals.columns])


def detach_reports(
    signals: DataFrame, members: DataFrame, gone: DataFrame, at: Column, window: int, min_sessions: int, review_sessions: int, vectors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """members and signals after the reports of gone (report_id) went at `at`, as a purge does.

    The signals that had them are worked out anew: too little evidence closes them, and one without members has counts of zero
    and keeps its bounds.
    """
    gone = gone.select("report_id").distinct()
    touched = members.join(gone, "report_id", "left_semi").select("signal_id").distinct().withColumn("at", at)
    left = members.join(gone, "report_id", "left_anti").select(*members.columns)
    return {"members": left, "signals": _recalculated(signals, left, touched, touched, window, min_sessions, review_sessions, vectors)}


def apply_merges(
    signals: DataFrame,
    members: DataFrame,
    requests: DataFrame,
    keys: list[str],
    wildcards: list[str],
    window: int,
    min_sessions: int,
    review_sessions: int,
    vectors: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """outcomes (request_id, source_id, target_id, outcome), members, signals and events after merge requests, taken in order of request_id.

    signals: signal_id, status, closure_reason, keys, wildcards, the columns of STATE, and closed_at and representative_id if
    they are kept; requests: request_id, source_id, target_id, at, actor_id, reason. Requests may share signals: each is judged
    on what the ones before it left (`decisions.judge_merges`). A merged source is closed and empty; its members go to the
    target, or where that went later, and of several rows of a report the one that was there first stays; the target takes the
    source's wildcards where it has none, and its evidence and state follow. events: a SIGNAL_MERGED entry for each merge, with
    the source's status before all requests.
    """
    judged = checkpoint(judge_merges(signals, requests, keys, wildcards))
    done = judged.filter("outcome = 'MERGED'").join(requests.select("request_id", "at"), "request_id")
    to = done.select(F.col("source_id").alias("signal_id"), F.col("root").alias("_root"), F.col("path").alias("_path"), F.col("at").alias("_at"), F.col("own_filters").alias("_own"))
    moved = members.join(to, "signal_id", "left").withColumn("signal_id", F.coalesce("_root", "signal_id"))
    place = F.row_number().over(W.partitionBy("signal_id", "report_id").orderBy(F.coalesce("_path", F.array().cast("array<long>"))))
    after = moved.withColumn("_place", place).filter("_place = 1").select(*members.columns)
    roots = done.groupBy(F.col("root").alias("signal_id")).agg(F.first("filters").alias("_filters"), F.max("at").alias("at"))
    marked = signals.join(to, "signal_id", "left").join(roots.select("signal_id", "_filters"), "signal_id", "left")
    gone = F.col("_root").isNotNull()
    empty = {"raw_report_count": F.lit(0), "unique_sessions": F.lit(0), "review_priority": F.lit(False), "status": F.lit("CLOSED"), "closure_reason": F.lit("MERGED")}
    changed = {c: F.when(gone, v).otherwise(F.col(c)) for c, v in empty.items()} | closed(signals, F.col("_at"), gone)
    taken = F.coalesce("_own", "_filters")
    changed |= {c: F.coalesce(F.col(c), taken[i].cast(signals.schema[c].dataType)) for i, c in enumerate(wildcards)}
    marked = marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in signals.columns])
    events = audit_events(judged.withColumn("after_status", F.lit("CLOSED")), requests, "MERGED", "SIGNAL_MERGED", "target_id")
    return {
        "outcomes": judged.select("request_id", "source_id", "target_id", "outcome"),
        "members": after,
        "signals": _recalculated(marked, after, roots.filter("false"), roots, window, min_sessions, review_sessions, vectors),
        "events": events,
    }


def apply_splits(
    signals: DataFrame, members: DataFrame, requests: DataFrame, window: int, min_sessions: int, review_sessions: int, vectors: DataFrame | None = None
) -> dict[str, DataFrame]:
    """outcomes (request_id, source_id, new_id, outcome), members, signals and events after the split requests.

    requests: request_id, source_id, new_id, report_id, at, actor_id, reason, a row for each chosen report; a source is split
    once. Refused: a missing or closed source, a chosen report that is no member, and all members chosen. The chosen reports go
    to a new candidate with the source's gate, and the evidence of both follows; too little of it closes the source. events: a
    SIGNAL_SPLIT entry for each split, with the source's status after it.
    """
    asked = requests.select("request_id", "source_id", "new_id", "report_id", "at").distinct()
    own = members.select(F.col("signal_id").alias("source_id"), "report_id", F.lit(1).alias("own"))
    sizes = members.groupBy(F.col("signal_id").alias("source_id")).agg(F.count("*").alias("size"))
    counted = asked.join(own, ["source_id", "report_id"], "left").groupBy("request_id", "source_id", "new_id", "at").agg(F.count("*").alias("chosen"), F.count("own").alias("found"))
    states = signals.select(F.col("signal_id").alias("source_id"), "status")
    outcome = (
        F.when(F.col("status").isNull(), "SIGNAL_NOT_FOUND")
        .when(F.col("status") == "CLOSED", "INVALID_SIGNAL_STATE")
        .when(F.col("found") < F.col("chosen"), "SIGNAL_MEMBER_NOT_FOUND")
        .when(F.col("found") == F.col("size"), "EMPTY_SOURCE_SIGNAL")
        .otherwise("SPLIT")
    )
    judged = checkpoint(counted.join(states, "source_id", "left").join(sizes, "source_id", "left").select("request_id", "source_id", "new_id", "at", outcome.alias("outcome")))
    done = judged.filter("outcome = 'SPLIT'")
    go = asked.join(done.select("request_id"), "request_id").select(F.col("source_id").alias("signal_id"), "report_id", F.col("new_id").alias("_new"))
    after = members.join(go, ["signal_id", "report_id"], "left").withColumn("signal_id", F.coalesce("_new", "signal_id")).select(*members.columns)
    fresh = signals.join(done.select(F.col("source_id").alias("signal_id"), F.col("new_id").alias("_new")), "signal_id")
    begin = {"signal_id": F.col("_new"), "status": F.lit("CANDIDATE"), "closure_reason": F.lit(None).cast("string")}
    begin |= {c: F.lit(None).cast(signals.schema[c].dataType) for c in ("closed_at", "representative_id") if c in signals.columns}
    fresh = fresh.select(*[begin[c].alias(c) if c in begin else F.col(c) for c in signals.columns])
    old = done.select(F.col("source_id").alias("signal_id"), "at")
    touched = old.unionByName(done.select(F.col("new_id").alias("signal_id"), "at"))
    found = _recalculated(signals.unionByName(fresh), after, old, touched, window, min_sessions, review_sessions, vectors)
    told = done.join(found.select(F.col("signal_id").alias("source_id"), F.col("status").alias("after_status")), "source_id").withColumn("before_status", F.col("after_status"))
    return {
        "outcomes": judged.select("request_id", "source_id", "new_id", "outcome"),
        "members": after,
        "signals": found,
        "events": audit_events(told, requests, "SPLIT", "SIGNAL_SPLIT", "new_id"),
    }
