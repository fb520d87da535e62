"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from websift.llm.encode import token_counts
from websift.llm.lines import small
from websift.session import materialise


def plan(sizes: DataFrame, targets: DataFrame, tilt: float = 0.5) -> DataFrame:
    """mix_id, source, target_share, max_repeats, tokens, share, demand, slope: how many tokens each source gives to each mix.

    sizes: source, tokens. A source that is absent, empty, has no target or may not be used can give nothing; the shares of
    the others are scaled up to 1. A mix is as large as its scarcest source allows: demand = share * min(max_repeats * tokens
    / share), so every share is met. slope: the source's weight at time t of the training, from 0 to 1, is share * (1 + slope * (2t - 1));
    sources that may be repeated more come later. Weights add up to 1 at all times, as the slopes' mean weighted by share is 0.
    A source named twice in a mix counts once, with the higher of each value. targets is a table of a few rows; a column slope of it
    is the schedule in place of tilt: the mean slope of a mix, weighted by share, is taken off, and slopes are scaled to at most 1.
    """
    given = F.max(F.coalesce("slope", F.lit(0.0))) if "slope" in targets.columns else F.max(F.lit(None).cast("double"))
    want = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), given.alias("given"))
    w = want.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    usable = F.when((F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0), F.col("target_share")).otherwise(0.0)
    mix = Window.partitionBy("mix_id")
    w = w.withColumn("share", usable)
    w = w.withColumn("share", F.when(F.sum("share").over(mix) > 0, F.col("share") / F.sum("share").over(mix)).otherwise(0.0))
    w = w.withColumn("size", F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(mix))
    w = w.withColumn("demand", F.coalesce(F.col("share") * F.col("size"), F.lit(0.0)))
    wish = F.coalesce(F.col("given"), F.col("max_repeats").cast("double"))
    w = w.withColumn("away", wish - F.sum(F.col("share") * wish).over(mix))
    widest = F.max(F.when(F.col("share") > 0, F.abs("away"))).over(mix)
    scaled = F.when(F.col("given").isNull(), F.lit(tilt) * F.col("away") / widest).otherwise(F.col("away") / F.greatest(widest, F.lit(1.0)))
    return w.withColumn("slope", F.when((F.col("share") > 0) & (widest > 1e-9), scaled).otherwise(0.0)).drop("size", "away", "given")


def mix(documents: DataFrame, targets: DataFrame, tilt: float = 0.5, rows_a_bucket: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(positions, plan). positions: mix_id, source, doc_id, copy, n_tokens, position: every use of a document, with its time in the training, from 0 to 1.

    Documents with a null source, id or text, or without a token, are not used; a doc_id that stands more than once in a source counts once.
    The copies of a source are passes over all its documents in an order by hash; the last pass ends where the demand is
    met: a document belongs to it if its middle does. position inverts the source's cumulative demand: after x of demand D tokens,
    D * (t + slope * (t^2 - t)) = x. An empty table, or a mix without usable source, has no rows.

    The running sum over a source is taken in hash buckets (sums of the buckets first, then within a bucket), so no source is
    in one task, whatever its share of all rows.
    """
    wanted = small(materialise(targets.select("source").where("source is not null").distinct(), "mix-sources"))
    # Documents of the sources that a mix names; only these are encoded.
    docs = documents.where("source is not null and doc_id is not null and text is not null").select("doc_id", "text", "source").join(wanted, "source", "left_semi")
    counts = token_counts(docs, also=("source",)).where("n_tokens > 0")
    sized = materialise(counts.groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    p = materialise(plan(sizes, targets, tilt), "mix-plan")
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / rows_a_bucket)).cast("int")
    passes = p.where("demand > 0").select("mix_id", "source", "demand", "slope", "tokens", "docs", n_buckets.alias("buckets"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("demand") / F.col("tokens")) - 1).cast("int"))).alias("copy"))
    uses = sized.join(small(materialise(passes, "mix-passes")), "source")  # a row for each copy of each source of a mix
    order = F.xxhash64("doc_id", "copy", "mix_id")
    uses = uses.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 16), F.col("buckets")).cast("int"))
    uses = materialise(uses, "mix-uses")
    groups = uses.groupBy("mix_id", "source", "copy", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("mix_id", "source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("mix_id", "source", "copy", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("mix_id", "source", "copy", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = uses.join(groups, ["mix_id", "source", "copy", "bucket"]).withColumn("x", F.col("offset") + F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2)
    placed = placed.where("x < demand")
    a, y = F.col("slope"), F.col("x") / F.col("demand")
    time = F.when(F.abs(a) < 1e-9, y).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / (2 * a))
    return placed.select("mix_id", "source", "doc_id", "copy", "n_tokens", time.alias("position")), p


def order_by_position(positions: DataFrame) -> DataFrame:
    """A range sort: the rows of a mix in training order over all partitions, ties by source, document and copy."""
    return positions.orderBy("mix_id", "position", "source", "doc_id", "copy")


def shares(positions: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_id, source, target_share, reached_share, tokens_used, documents_used, most_repeats of each source of each mix, also of those that gave nothing."""
    used = positions.groupBy("mix_id", "source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    used = used.groupBy("mix_id", "source").agg(F.sum("n").alias("tokens_used"), F.sum("k").alias("documents_used"), F.max("k").alias("most_repeats"))
    out = plan.select("mix_id", "source", "target_share", "max_repeats").join(used, ["mix_id", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    total = F.sum("tokens_used").over(Window.partitionBy("mix_id"))
    return out.select("mix_id", "source", "target_share", "max_repeats", F.coalesce(F.col("tokens_used") / total, F.lit(0.0)).alias("reached_share"), zero("tokens_used"), zero("documents_used"), zero("most_repeats"))
