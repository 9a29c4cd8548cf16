"""Findings fold into one decision per record and use: one aggregation over (record, use), which combines on the map
side. Nothing is decided record by record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"review": 1, "error": 2}
STATUS = ("admitted", "review_required", "rejected")


def contract_column(contracts: Mapping[str, Sequence[str]]) -> Column:
    """The declared contracts as a literal array<struct<use, required_type>>, with a null type for a use that requires
    none; exploded beside a record it gives the record's demands without a join."""
    rows = [(use, t) for use, types in contracts.items() for t in (types or [None])]
    return F.array(*[F.struct(F.lit(u).alias("use"), F.lit(t).cast("string").alias("required_type")) for u, t in rows])


def decide(findings: DataFrame, asked: DataFrame) -> DataFrame:
    """(record_id, use, status, reason_codes) for every asked (record_id, use): the gravest finding that concerns the
    use, and the sorted distinct rules."""
    rank = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (k, v)])[F.col("severity")]
    per = findings.groupBy("record_id", "use").agg(F.max(rank).alias("rank"), F.collect_set("rule_id").alias("rules"))
    own = per.where("use is not null")
    every = per.where("use is null").drop("use").withColumnsRenamed({"rank": "rank_all", "rules": "rules_all"})
    both = asked.select("record_id", "use").join(own, ["record_id", "use"], "left").join(every, "record_id", "left")
    none = F.array().cast("array<string>")
    worst = F.greatest(F.coalesce("rank", F.lit(0)), F.coalesce("rank_all", F.lit(0)))
    rules = F.array_sort(F.array_union(F.coalesce("rules", none), F.coalesce("rules_all", none)))
    return both.select("record_id", "use", F.element_at(F.array(*[F.lit(s) for s in STATUS]), worst + 1).alias("status"), F.array_join(rules, "|").alias("reason_codes"))


def overall(decisions: DataFrame) -> DataFrame:
    """(record_id, overall): the gravest status over a record's uses."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("status"))
    return decisions.groupBy("record_id").agg(F.max_by("status", order).alias("overall"))
