"""Sources mixed to target shares of all tokens.

Every document gets a hash-random key. Keys fall into equal ranges, of which each source has enough to keep a range of
bounded size; documents are sorted within a range, and ranges add up over a small table, which gives every document the
tokens before it in its source without ever bringing a source together. A source is cut where its budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut

RANGE_ROWS = 20_000


def budgets(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, n_docs, budget, passes, rest): tokens each source gives.

    Without `total_tokens` the total is the largest at which every source with documents reaches its share within its
    repeats, so the shares come out exactly; with it, sources that can't reach their share give all they may. Sources
    without documents give nothing. Null or negative shares and repeats count as 0.
    """
    t = targets.select(F.coalesce("source", F.lit("")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("int").alias("max_repeats"))
    both = t.join(totals, "source", "left").na.fill(0, ["available", "n_docs"])
    most = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        whole = F.floor(F.min(F.when((F.col("target_share") > 0) & (most > 0), most / F.col("target_share"))).over(Window.partitionBy()) + 1e-6)
    else:
        whole = F.lit(total_tokens)
    budget = F.least(most, F.coalesce(F.round(whole * F.col("target_share")).cast("long"), F.lit(0)))
    both = both.withColumn("budget", budget).withColumn("passes", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
    return both.withColumn("rest", F.col("budget") - F.col("passes") * F.col("available"))


def mixed(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 20240229, doc_id: str = "doc_id", source: str = "source", n_tokens: str = "n_tokens") -> DataFrame:
    """(source, doc_id, epoch, n_tokens): the selection, a row per use of a document; epoch counts its uses from 0.

    A source is cut at the document that brings it nearest to its budget, never beyond max_repeats uses of a document.
    Documents with a null id or size, of no tokens, or of a source without a target are left out; a repeated row counts
    once; a null source is ''. The same seed gives the same selection.
    """
    key = F.xxhash64(F.lit(seed), "doc_id")
    docs = sizes.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(n_tokens).alias("n")).where("doc_id is not null and n > 0").distinct()
    docs = cut(docs.join(targets.select(F.coalesce("source", F.lit("")).alias("source")).distinct(), "source", "left_semi").withColumn("key", key))
    plan = cut(budgets(docs.groupBy("source").agg(F.sum("n").alias("available"), F.count("*").alias("n_docs")), targets, total_tokens))
    # the place of the key among all keys, in as many equal ranges as the source needs
    place = F.shiftrightunsigned("key", 32).cast("double") / (1 << 32)
    ranged = docs.join(plan.select("source", "n_docs", "max_repeats", "passes", "rest"), "source").withColumn("part", F.floor(place * F.ceil(F.col("n_docs") / RANGE_ROWS)))
    parts = ranged.groupBy("source", "part").agg(F.sum("n").alias("in_part"))
    ahead = parts.select("source", "part", (F.sum("in_part").over(Window.partitionBy("source").orderBy("part")) - F.col("in_part")).alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy(F.shiftrightunsigned("key", 32), "key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inside), F.lit(0))
    # the range table joins by its key, so it may grow with the data
    placed = ranged.withColumn("inside", before).join(ahead, ["source", "part"])
    more = (F.col("ahead") + F.col("inside") + F.col("n") / 2 <= F.col("rest")) & (F.col("passes") < F.col("max_repeats"))
    uses = F.col("passes") + more.cast("int")
    return placed.withColumn("uses", uses).where("uses > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("epoch"), F.col("n").alias("n_tokens"))


def shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, **columns) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, share_reached, most_uses) of every target source."""
    got = mixed(sizes, targets, total_tokens, **columns).groupBy("source").agg(F.sum("n_tokens").alias("t"), (F.max("epoch") + 1).alias("u"))
    t = F.coalesce("t", F.lit(0)).cast("long")
    return (
        targets.select(F.coalesce("source", F.lit("")).alias("source"), "target_share", "max_repeats")
        .join(got, "source", "left")
        .select("source", "target_share", "max_repeats", t.alias("n_tokens"), F.try_divide(t, F.sum(t).over(Window.partitionBy())).alias("share_reached"), F.coalesce("u", F.lit(0)).alias("most_uses"))
    )
