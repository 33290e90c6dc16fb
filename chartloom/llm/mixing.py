"""Mixing of sources to target shares of tokens (problem 7).

Entropy balancing: among all rates of the documents, those closest to "each document once" in relative entropy that
meet the token sum of each source are tilted exponentially: ``rate = min(cap, exp(dual * tokens / mean))`` with one
dual variable per source. Newton steps solve the convex dual; each step is one Spark aggregate of token moments over
the table of document lengths, and the dual variables stay in a table with one row per source. The rates of the
documents are then rounded into whole copies by cumulative rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartloom.llm.encode import token_count
from chartloom.session import broadcast_if_small, cut, is_small

#: Documents whose rounding one window carries forward; sources are spread over buckets of about this size.
BUCKET = 4096
NEWTON_STEPS = 60
#: Relative error of a source's tokens at which its dual variable stands.
TOLERANCE = 1e-7


def _targets(targets: DataFrame) -> DataFrame:
    """One row per listed source. A source listed twice has its larger values."""
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return listed.select("source", "target_share", "max_repeats")


def _rate(dual: str = "dual") -> Column:
    """Tilted rate of a document; a null dual variable stands for the cap."""
    return F.coalesce(F.least(F.col("cap"), F.exp(F.col(dual) * F.col("tokens") / F.col("mean"))), F.col("cap"))


def _goals(lengths: DataFrame, total: float | None) -> DataFrame:
    """Per source with tokens, share and cap: how many tokens it shall give (``goal``) and its mean length.

    Without a total, the largest one is taken at which every such source can hold its share under its cap.
    """
    sums = (
        lengths.where("share > 0 and cap > 0").groupBy("source", "share", "cap")
        .agg(F.sum(F.col("n") * F.col("tokens")).alias("all_tokens"), (F.sum(F.col("n") * F.col("tokens")) / F.sum("n")).alias("mean"))
    )
    reach = F.col("cap") * F.col("all_tokens")
    whole = sums.agg(F.sum("share").alias("shares"), F.min(reach / F.col("share")).alias("largest"))
    whole = whole.select("shares", (F.col("largest") if total is None else F.lit(float(total)) / F.col("shares")).alias("per_share"))  # one row
    return sums.crossJoin(F.broadcast(whole)).select("source", "cap", "mean", F.least(reach, F.col("share") * F.col("per_share")).alias("goal"), (F.col("share") * F.col("per_share") >= reach * (1 - 1e-9)).alias("full"))


def dual_variables(lengths: DataFrame, total: float | None = None, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source, cap, mean, goal, dual): the dual variable of each source whose documents can take part.

    ``lengths`` has source, tokens, n (documents of this length), share and cap. The sources share no document, so the
    dual's Hessian is diagonal. A step that leaves the bracket of its source is replaced by halving the bracket. Where
    the goal takes all copies there are, the dual variable is null.
    """
    state = _goals(lengths, total).select(
        "*", F.when(~F.col("full"), F.lit(0.0)).alias("dual"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("full").alias("done")
    )
    state = cut(state)
    near = F.broadcast if is_small(state) else (lambda df: df)
    lengths = lengths.select("source", "tokens", "n")
    for _ in range(steps):
        rate, mass = _rate(), F.col("n") * F.col("tokens")
        moments = (
            lengths.join(near(state.where("not done").select("source", "cap", "mean", "dual")), "source")
            .groupBy("source").agg(F.sum(mass * rate).alias("given"), F.sum(F.when(rate < F.col("cap"), mass * F.col("tokens") / F.col("mean") * rate)).alias("slope"))
        )
        dual, error = F.col("dual"), F.col("given") - F.col("goal")
        low, high = F.when(error < 0, dual).otherwise(F.col("low")), F.when(error > 0, dual).otherwise(F.col("high"))
        newton = dual - F.try_divide(error, F.col("slope"))
        fits = (F.abs(newton - dual) <= 2 + 2 * F.abs(dual)) & F.coalesce(newton > low, F.lit(True)) & F.coalesce(newton < high, F.lit(True))
        halved = F.when(low.isNull(), 2 * dual - 1).when(high.isNull(), 2 * dual + 1).otherwise((low + high) / 2)
        stands = F.col("done") | (F.abs(error) <= TOLERANCE * F.col("goal"))
        following = F.when(stands, dual).when(fits, newton).otherwise(halved)
        state = cut(state.join(moments, "source", "left").select("source", "cap", "mean", "goal", "full", following.alias("dual"), low.alias("low"), high.alias("high"), stands.alias("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("source", "cap", "mean", "goal", "dual")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per document of a listed source: doc_id, source, tokens, rate, copies.

    ``copies`` is between 0 and the source's max_repeats. Documents without tokens (null or empty text) have 0
    copies. Documents of unlisted or null sources are left out. A source listed twice has its larger values; a null
    share or cap counts as 0. Repeated documents count each.
    """
    listed = _targets(targets).select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).cast("double").alias("cap"))
    measured = docs.select("doc_id", "source", "text").join(broadcast_if_small(listed), "source")
    measured = cut(measured.withColumn("tokens", token_count(F.col("text"), vocabulary)).drop("text"))
    # A rate depends on source and length only: one row per length of a source is all that the steps read.
    lengths = cut(measured.where("tokens > 0").groupBy("source", "tokens", "share", "cap").agg(F.count("*").alias("n")))
    duals = dual_variables(lengths, total_tokens)
    sizes = measured.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET)).alias("buckets"))
    rated = measured.drop("cap", "share").join(broadcast_if_small(sizes.join(duals, "source", "left")), "source")
    rated = rated.withColumn("rate", F.when((F.col("tokens") > 0) & F.col("goal").isNotNull(), _rate()).otherwise(F.lit(0.0)))
    # Cumulative rounding over documents of similar size: each gets the whole copies that its rate completes.
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    start = F.when(F.col("buckets") == 1, 0.5).otherwise(F.pmod(F.xxhash64("source", "bucket"), F.lit(1000)) / 1000)
    upto = F.sum("rate").over(W.partitionBy("source", "bucket").orderBy(F.desc("tokens"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rated = rated.withColumn("upto", upto + start)
    copies = F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("rate") + 1e-9)
    return rated.select("doc_id", "source", "tokens", F.round("rate", 9).alias("rate"), F.least(copies, F.coalesce("cap", F.lit(0.0)).cast("long")).cast("int").alias("copies"))


def mixture_shares(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """One row per listed source: target_share, max_repeats, docs, tokens, rate (mean, by tokens), copies, mixed_tokens, actual_share."""
    mixed = mixture(docs, targets, **options).groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.round(F.try_divide(F.sum(F.col("rate") * F.col("tokens")), F.sum("tokens")), 6).alias("rate"),
        F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"),
    )
    mixed = cut(mixed)
    everything = mixed.agg(F.sum("mixed_tokens").alias("all_tokens"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "tokens", "rate", "copies", "mixed_tokens")]
    return (
        _targets(targets).join(mixed, "source", "left").crossJoin(F.broadcast(everything))  # one row
        .select("source", "target_share", "max_repeats", *filled, F.round(F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
    )
