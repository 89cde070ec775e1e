"""Symbol master: verification, reconciliation with a listed snapshot, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.99
LOOKBACK_DAYS = 14


def latest_available(snapshots: DataFrame, today: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The rows of the newest snapshot before today, at most `days` back."""
    dated = snapshots.filter((F.col("as_of") < today) & (F.col("as_of") >= F.date_sub(today, days)))
    newest = dated.agg(F.max("as_of").alias("as_of"))
    return dated.join(F.broadcast(newest), "as_of")


def verify(symbols: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: symbols, matched, coverage, market_conflicts, unknown_listed, name_changes, ok."""
    both = symbols.select("code", F.col("market").alias("m"), F.col("name").alias("n"), F.lit(True).alias("own")).join(
        listed.select("code", F.col("market").alias("lm"), F.col("name").alias("ln"), F.lit(True).alias("api")), "code", "full_outer"
    )
    counted = both.agg(
        F.count_if(F.col("own")).alias("symbols"),
        F.count_if(F.col("own") & F.col("api")).alias("matched"),
        F.count_if(F.col("m") != F.col("lm")).alias("market_conflicts"),
        F.count_if(F.col("own").isNull()).alias("unknown_listed"),
        F.count_if(F.col("n") != F.col("ln")).alias("name_changes"),
    )
    coverage = F.col("matched") / F.nullif(F.col("symbols"), F.lit(0))
    ok = F.coalesce(coverage >= MIN_COVERAGE, F.lit(False)) & (F.col("market_conflicts") == 0)
    return counted.withColumn("coverage", coverage).withColumn("ok", ok)


def reconcile(baseline: DataFrame, active: DataFrame, listed: DataFrame, as_of: Column) -> DataFrame:
    """(code, outcome, last_seen_on, missing_since) for each baseline symbol.

    Listed symbols are SEEN, back in the master if they had gone; a missing one
    is PENDING on its first date and REMOVED on a later one; one that is neither
    listed nor active is ABSENT. active: code, last_seen_on, missing_since.
    """
    joined = (
        baseline.select("code")
        .join(active.select("code", F.col("last_seen_on").alias("seen"), F.col("missing_since").alias("missing"), F.lit(True).alias("is_active")), "code", "left")
        .join(listed.select("code", F.lit(True).alias("is_listed")), "code", "left")
    )
    outcome = (
        F.when(F.col("is_listed"), "SEEN")
        .when(F.col("is_active").isNull(), "ABSENT")
        .when(F.col("missing") < as_of, "REMOVED")
        .otherwise("PENDING")
    )
    return joined.withColumn("outcome", outcome).select(
        "code",
        "outcome",
        F.when(F.col("outcome") == "SEEN", as_of).when(F.col("outcome") == "PENDING", F.col("seen")).alias("last_seen_on"),
        F.when(F.col("outcome") == "PENDING", as_of).alias("missing_since"),
    )


def next_active(reconciled: DataFrame) -> DataFrame:
    """The symbols that the next version holds."""
    return reconciled.filter(F.col("outcome").isin("SEEN", "PENDING")).select("code", "last_seen_on", "missing_since")


def validate(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (request_id, symbol_code, symbol_name) with result: null without a code, else UNSUPPORTED, MISMATCH or MATCHED."""
    code = F.nullif(F.col("symbol_code"), F.lit("UNKNOWN"))
    joined = requests.withColumn("code", code).join(symbols.select("code", F.col("name").alias("master_name")), "code", "left")
    differs = F.col("symbol_name").isNotNull() & (F.col("symbol_name") != F.col("master_name"))
    result = F.when(F.col("code").isNotNull(), F.when(F.col("master_name").isNull(), "UNSUPPORTED").when(differs, "MISMATCH").otherwise("MATCHED"))
    return joined.select("request_id", result.alias("result"))


def activate(versions: DataFrame) -> DataFrame:
    """versions (version, as_of) with is_active on the newest alone."""
    key = F.struct("as_of", "version")
    newest = versions.agg(F.max(key).alias("_newest"))  # a single row
    return versions.crossJoin(F.broadcast(newest)).withColumn("is_active", key.eqNullSafe(F.col("_newest"))).drop("_newest")
