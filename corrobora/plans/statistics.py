"""Queries over aggregates and agreement statistics. Ratios come out in millionths, so that both engines agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators.packed import symbol_values
from ..tables import table
from .registry import Registry

query = Registry()
#: Values of a symbol list in SQL (symbols hold no delimiters, so quotes can go after the split).
SYMBOLS = r"list_filter(list_transform(string_split_regex(coalesce({0}, ''), '\s*[;；,，|\n]\s*|\s+/\s+'), lambda x: trim(x, ' \"')), lambda x: x <> '')".replace('\\"', '"')
_A = "(SELECT DISTINCT annotation_id, case_id, requested_use, reviewer_id, split, group_id, minutes_spent, regexp_replace(lower(trim(admission_label)), '[\\s-]+', '_', 'g') AS adm, regexp_replace(lower(trim(mapping_label)), '[\\s-]+', '_', 'g') AS map FROM annotations)"
_L = f"(SELECT case_id, requested_use, reviewer_id, max(adm) AS adm FROM {_A} WHERE adm IN ('admitted', 'review_required', 'rejected') GROUP BY ALL)"


def million(x):
    return F.floor(x * 1000000 + 0.5).cast("long")


def notes(spark, d):
    a = table(spark, d, "annotations")
    return a.select("annotation_id", "case_id", "requested_use", "reviewer_id", "split", "group_id", "minutes_spent", T.choice(F.col("admission_label")).alias("adm"), T.choice(F.col("mapping_label")).alias("map")).distinct()


def labels(spark, d):
    """One admission label per unit and reviewer."""
    return notes(spark, d).where(F.col("adm").isin("admitted", "review_required", "rejected")).groupBy("case_id", "requested_use", "reviewer_id").agg(F.max("adm").alias("adm"))


@query("op_A1", f"""SELECT case_id, requested_use, CASE max(CASE adm WHEN 'rejected' THEN 2 WHEN 'review_required' THEN 1 ELSE 0 END) WHEN 2 THEN 'rejected' WHEN 1 THEN 'review_required' ELSE 'admitted' END AS worst, array_to_string(list_sort(list(DISTINCT adm)), '|') AS codes FROM {_L} GROUP BY ALL""")
def severity_fold(spark, d):
    """The gravest of ordered grades per group, and the sorted distinct codes behind it."""
    rank = F.max(F.when(F.col("adm") == "rejected", 2).when(F.col("adm") == "review_required", 1).otherwise(0))
    return labels(spark, d).groupBy("case_id", "requested_use").agg(F.element_at(F.array(F.lit("admitted"), F.lit("review_required"), F.lit("rejected")), rank + 1).alias("worst"), F.array_join(F.array_sort(F.collect_set("adm")), "|").alias("codes"))


@query("op_A2", "SELECT record_id, array_to_string(list_sort(list(DISTINCT extraction_method)), '|') AS methods, array_to_string(list_sort(list(DISTINCT evidence_type)), '|') AS types FROM evidence_items GROUP BY record_id")
def distinct_sets(spark, d):
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return table(spark, d, "evidence_items").groupBy("record_id").agg(sets("extraction_method").alias("methods"), sets("evidence_type").alias("types"))


@query("op_A3", "SELECT evidence_type, count_if(extraction_method = 'llm_extraction') AS llm, count_if(extraction_method = 'string_match') AS matched, count(*) AS n FROM (SELECT DISTINCT id, evidence_type, extraction_method FROM evidence_items) GROUP BY evidence_type")
def counts(spark, d):
    rows = table(spark, d, "evidence_items").select("id", "evidence_type", "extraction_method").distinct()
    return rows.groupBy("evidence_type").agg(F.count_if(F.col("extraction_method") == "llm_extraction").alias("llm"), F.count_if(F.col("extraction_method") == "string_match").alias("matched"), F.count("*").alias("n"))


_WIL = "CAST(floor(1000000 * {0} + 0.5) AS BIGINT)"
_C, _H = "((p + 1.920729410347063 / n) / (1 + 3.841458820694126 / n))", "(1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694126 / (4.0 * n * n)) / (1 + 3.841458820694126 / n))"


@query("op_A4", f"""WITH r AS (SELECT reviewer_id, count_if(adm = 'rejected') AS k, count(*) AS n, count_if(adm = 'rejected') / count(*) AS p FROM {_L} GROUP BY reviewer_id)
SELECT reviewer_id, k, n, {_WIL.format(f'greatest(0.0, {_C} - {_H})')} AS low, {_WIL.format(f'least(1.0, {_C} + {_H})')} AS high FROM r""")
def rates(spark, d):
    r = labels(spark, d).groupBy("reviewer_id").agg(F.count_if(F.col("adm") == "rejected").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return r.select("reviewer_id", "k", "n", million(low).alias("low"), million(high).alias("high"))


_PRED = f"(SELECT case_id, requested_use, arg_max(adm, c) AS truth FROM (SELECT case_id, requested_use, adm, count(*) * 10 + CASE adm WHEN 'rejected' THEN 2 WHEN 'review_required' THEN 1 ELSE 0 END AS c FROM {_L} GROUP BY case_id, requested_use, adm) GROUP BY ALL)"


def majority(spark, d):
    return labels(spark, d).groupBy("case_id", "requested_use", "adm").agg(F.count("*").alias("k")).withColumn("c", F.col("k") * 10 + F.when(F.col("adm") == "rejected", 2).when(F.col("adm") == "review_required", 1).otherwise(0)).groupBy("case_id", "requested_use").agg(F.max_by("adm", "c").alias("truth"))


@query("op_A5", f"""WITH s AS (SELECT l.reviewer_id AS method, l.requested_use AS subset, l.adm, p.truth FROM {_L} l JOIN {_PRED} p USING (case_id, requested_use)), x AS (SELECT * FROM s UNION ALL SELECT method, 'all', adm, truth FROM s)
SELECT method, subset, count(*) AS n, count_if(adm = truth) AS exact, count_if(truth <> 'admitted') AS negatives, count_if(truth <> 'admitted' AND adm = 'admitted') AS false_yes, count_if(truth = 'admitted' AND adm <> 'admitted') AS false_no FROM x GROUP BY ALL""")
def scores(spark, d):
    """Scores per method and subset, every row also counting in the subset 'all' (once, if that is its own)."""
    s = labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"])
    s = s.select(F.col("reviewer_id").alias("method"), F.explode(F.array_distinct(F.array("requested_use", F.lit("all")))).alias("subset"), "adm", "truth")
    yes, true = F.col("adm") == "admitted", F.col("truth") == "admitted"
    return s.groupBy("method", "subset").agg(F.count("*").alias("n"), F.count_if(F.col("adm") == F.col("truth")).alias("exact"), F.count_if(~true).alias("negatives"), F.count_if(~true & yes).alias("false_yes"), F.count_if(true & ~yes).alias("false_no"))


_PAIRS = f"(SELECT a.requested_use, a.reviewer_id AS r1, b.reviewer_id AS r2, a.adm AS x, b.adm AS y FROM {_L} a JOIN {_L} b ON a.case_id = b.case_id AND a.requested_use = b.requested_use AND a.reviewer_id < b.reviewer_id)"


def pairs_of_reviewers(spark, d):
    """Votes of two reviewers on one unit (J21). A unit holds few reviewers, so the pairs stay few."""
    a = labels(spark, d)
    b = a.select("case_id", "requested_use", F.col("reviewer_id").alias("r2"), F.col("adm").alias("y"))
    return a.join(b, ["case_id", "requested_use"]).where("reviewer_id < r2").select("requested_use", F.col("reviewer_id").alias("r1"), "r2", F.col("adm").alias("x"), "y")


@query("op_A6", f"""WITH c AS (SELECT requested_use, x, y, count(*) AS c FROM {_PAIRS} GROUP BY ALL), t AS (SELECT requested_use, sum(c) AS n, sum(CASE WHEN x = y THEN c ELSE 0 END) AS o FROM c GROUP BY 1),
e AS (SELECT a.requested_use, sum(a.r * b.r) AS e FROM (SELECT requested_use, x AS k, sum(c) AS r FROM c GROUP BY ALL) a JOIN (SELECT requested_use, y AS k, sum(c) AS r FROM c GROUP BY ALL) b USING (requested_use, k) GROUP BY 1)
SELECT requested_use, CAST(n AS BIGINT) AS n, CAST(floor(1000000 * ((o / n - e / (n * n)) / (1 - e / (n * n))) + 0.5) AS BIGINT) AS kappa FROM t JOIN e USING (requested_use)""")
def kappas(spark, d):
    return S.kappa(pairs_of_reviewers(spark, d), "x", "y", ["requested_use"]).select("requested_use", "n", million(F.col("kappa")).alias("kappa"))


@query("op_A7", f"""WITH c AS (SELECT requested_use, case_id, adm, count(*) AS c FROM {_L} GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY requested_use, case_id) AS m FROM c), k AS (SELECT * FROM m WHERE m >= 2),
p AS (SELECT requested_use, adm, sum(c) AS t, sum(c * (c - 1) / (m - 1)) AS same FROM k GROUP BY ALL), s AS (SELECT requested_use, sum(t) AS n, sum(same) AS same, sum(t * t) AS tt FROM p GROUP BY 1)
SELECT requested_use, CAST(floor(1000000 * (1 - (n - same) / ((n * n - tt) / (n - 1))) + 0.5) AS BIGINT) AS alpha FROM s""")
def alphas(spark, d):
    return S.nominal_alpha(labels(spark, d), ["case_id"], "adm", ["requested_use"]).select("requested_use", million(F.col("alpha")).alias("alpha"))


@query("op_A8", f"SELECT requested_use, count(*) AS units, count_if(k = 1) AS agreed FROM (SELECT requested_use, case_id, count(DISTINCT adm) AS k, count(*) AS n FROM {_L} GROUP BY ALL) WHERE n >= 2 GROUP BY 1")
def percent_agreement(spark, d):
    u = labels(spark, d).groupBy("requested_use", "case_id").agg(F.count_distinct("adm").alias("k"), F.count("*").alias("n")).where("n >= 2")
    return u.groupBy("requested_use").agg(F.count("*").alias("units"), F.count_if(F.col("k") == 1).alias("agreed"))


@query("op_A9")
def bootstrap(spark, d):
    """Interval of alpha per use, of 2,000 resamples; a group's units come and are drawn as counts of counts patterns, of
    which there are few."""
    names = ["admitted", "review_required", "rejected"]
    u = labels(spark, d).groupBy("requested_use", "case_id").agg(*[F.count_if(F.col("adm") == n).cast("int").alias(n) for n in names], F.count("*").alias("m")).where("m >= 2")
    u = u.groupBy("requested_use", *names).agg(F.count("*").alias("times"))

    def run(pdf):
        import pandas as pd

        rows = sorted(zip(*[pdf[n] for n in names], pdf["times"]))
        got = S.resampled_alpha([list(map(int, r[:3])) for r in rows], [int(r[3]) for r in rows])
        return pd.DataFrame({"requested_use": pdf["requested_use"].iloc[:1], "low": [got and got[0]], "high": [got and got[1]]})

    return u.groupBy("requested_use").applyInPandas(run, "requested_use string, low double, high double")


@query("op_A10")
def bounds(spark, d):
    r = labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"]).groupBy("reviewer_id").agg(F.count_if(F.col("adm") != F.col("truth")).alias("errors"), F.count("*").alias("n"))
    return r.select("reviewer_id", "errors", "n", S.exact_bounds("errors", "n").alias("bound"))


@query("op_A11")
def sizes(spark, d):
    return spark.createDataFrame([(t, S.sample_size(t)) for t in (0.01, 0.05, 0.1)], "target double, n int")


@query("op_A12", f"""SELECT requested_use AS route, count(*) AS audited, CAST(floor(sum(coalesce(minutes_spent, 0)) * 10 + 0.5) AS BIGINT) AS tenth_minutes, CAST(floor(1000000.0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS share FROM {_A} GROUP BY 1""")
def route_rollup(spark, d):
    r = notes(spark, d).groupBy(F.col("requested_use").alias("route")).agg(F.count("*").alias("audited"), F.floor(F.sum(F.coalesce("minutes_spent", F.lit(0.0))) * 10 + 0.5).alias("tenth_minutes"))
    return r.withColumn("share", million(F.col("audited") / F.sum("audited").over(Window.partitionBy())))


_RISK = f"(SELECT l.reviewer_id, l.requested_use = 'expert_panel' AS flagged, l.adm <> p.truth AS wrong FROM {_L} l JOIN {_PRED} p USING (case_id, requested_use))"


def _risk(spark, d):
    return labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"]).select("reviewer_id", (F.col("requested_use") == "expert_panel").alias("flagged"), (F.col("adm") != F.col("truth")).alias("wrong"))


@query("op_A13", f"""WITH t AS (SELECT count_if(flagged AND wrong) + 0.0 AS a, count_if(flagged) + 0.0 AS n1, count_if(NOT flagged AND wrong) + 0.0 AS c, count_if(NOT flagged) + 0.0 AS n2 FROM {_RISK})
SELECT CAST(floor(10000 * (a / n1) / (c / n2) + 0.5) AS BIGINT) AS ratio, CAST(floor(10000 * (a / n1) / (c / n2) * exp(-1.959963984540054 * sqrt(1 / a - 1 / n1 + 1 / c - 1 / n2)) + 0.5) AS BIGINT) AS low FROM t""")
def risk(spark, d):
    f, w = F.col("flagged"), F.col("wrong")
    r = _risk(spark, d).agg(F.count_if(f & w).alias("a"), F.count_if(f).alias("n1"), F.count_if(~f & w).alias("c"), F.count_if(~f).alias("n2"))
    rr = S.risk_ratio(*[F.col(x) for x in ("a", "n1", "c", "n2")])
    return r.select(F.floor(10000 * rr["ratio"] + 0.5).alias("ratio"), F.floor(10000 * rr["low"] + 0.5).alias("low"))


@query("op_A14", f"WITH s AS (SELECT reviewer_id, avg(CASE WHEN wrong THEN 1.0 ELSE 0 END) > 0.2 AS above FROM {_RISK} GROUP BY 1) SELECT CASE WHEN bool_or(above) AND NOT bool_or(NOT above) THEN 'shown' WHEN bool_or(above) THEN 'indicative' ELSE 'not shown' END AS verdict FROM s")
def verdict(spark, d):
    s = _risk(spark, d).groupBy("reviewer_id").agg((F.avg(F.col("wrong").cast("int")) > 0.2).alias("above"))
    return s.agg(F.when(F.bool_or("above") & ~F.bool_or(~F.col("above")), "shown").when(F.bool_or("above"), "indicative").otherwise("not shown").alias("verdict"))


@query("op_A15", f"SELECT case_id, requested_use, CASE WHEN max(k) >= 4 THEN arg_max(adm, k * 10 + CASE adm WHEN 'rejected' THEN 2 WHEN 'review_required' THEN 1 ELSE 0 END) ELSE 'review_required' END AS vote FROM (SELECT case_id, requested_use, adm, count(*) AS k FROM {_L} GROUP BY ALL) GROUP BY ALL")
def quorum(spark, d, least=4):
    """The leading label of a unit if it has at least `least` votes, else it needs review."""
    c = labels(spark, d).groupBy("case_id", "requested_use", "adm").agg(F.count("*").alias("k"))
    order = F.col("k") * 10 + F.when(F.col("adm") == "rejected", 2).when(F.col("adm") == "review_required", 1).otherwise(0)
    return c.groupBy("case_id", "requested_use").agg(F.when(F.max("k") >= least, F.max_by("adm", order)).otherwise("review_required").alias("vote"))


@query("op_A16", f"SELECT case_id, requested_use, truth AS plurality, (SELECT count(DISTINCT adm) FROM {_L} l WHERE l.case_id = p.case_id AND l.requested_use = p.requested_use) = 1 AS unanimous FROM {_PRED} p")
def plurality(spark, d):
    one = labels(spark, d).groupBy("case_id", "requested_use").agg((F.count_distinct("adm") == 1).alias("unanimous"))
    return majority(spark, d).withColumnRenamed("truth", "plurality").join(one, ["case_id", "requested_use"])


@query("op_A17", f"SELECT r1, r2, count(*) AS units, count_if(x <> 'admitted') AS misses_1, count_if(y <> 'admitted') AS misses_2, count_if(x <> 'admitted' AND y <> 'admitted') AS shared FROM {_PAIRS} GROUP BY ALL")
def error_correlation(spark, d):
    x, y = F.col("x") != "admitted", F.col("y") != "admitted"
    return pairs_of_reviewers(spark, d).groupBy("r1", "r2").agg(F.count("*").alias("units"), F.count_if(x).alias("misses_1"), F.count_if(y).alias("misses_2"), F.count_if(x & y).alias("shared"))


@query("op_A19", "WITH s AS (SELECT DISTINCT task_id, unnest(source) AS s FROM llm_tasks) SELECT s.review_status AS review_status, count(*) AS n, count_if(lower(s.classification) LIKE '%conflict%') AS conflicting, count_if(lower(s.classification) LIKE '%uncertain%') AS uncertain FROM s GROUP BY 1")
def stability(spark, d):
    s = table(spark, d, "llm_tasks").select("task_id", F.explode("source").alias("s")).distinct()
    c = F.lower("s.classification")
    return s.groupBy(F.col("s.review_status").alias("review_status")).agg(F.count("*").alias("n"), F.count_if(c.contains("conflict")).alias("conflicting"), F.count_if(c.contains("uncertain")).alias("uncertain"))


@query("op_A20", f"SELECT l.requested_use, p.truth AS reference, count(*) AS n, count_if(l.adm = p.truth) AS same FROM {_L} l JOIN {_PRED} p USING (case_id, requested_use) GROUP BY ALL")
def reproduction(spark, d):
    return labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"]).groupBy("requested_use", F.col("truth").alias("reference")).agg(F.count("*").alias("n"), F.count_if(F.col("adm") == F.col("truth")).alias("same"))


@query("op_A21", f"SELECT coalesce(reviewer_id, 'pooled') AS reviewer_id, requested_use, count(*) AS n, count_if(adm = 'admitted') AS admitted FROM {_L} GROUP BY GROUPING SETS ((reviewer_id, requested_use), (requested_use))")
def pooled(spark, d):
    g = labels(spark, d).groupingSets([["reviewer_id", "requested_use"], ["requested_use"]], "reviewer_id", "requested_use")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("adm") == "admitted").alias("admitted")).select(F.coalesce("reviewer_id", F.lit("pooled")).alias("reviewer_id"), "requested_use", "n", "admitted")


@query("op_A22", """WITH e AS (SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'add_to_cart' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS stage FROM events GROUP BY 1) SELECT stage, count(*) AS n FROM e GROUP BY 1""")
def funnel(spark, d):
    k = F.col("event_type")
    stage = F.max(F.when(k == "purchase", 3).when(k == "add_to_cart", 2).when(k == "click", 1).otherwise(0)).alias("stage")
    return table(spark, d, "events").groupBy("user_id").agg(stage).groupBy("stage").agg(F.count("*").alias("n"))


@query("op_A24", "SELECT o_orderpriority, CAST(floor(median(o_totalprice) * 100 + 0.5) AS BIGINT) AS median_cents, CAST(floor(list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] * 100 + 0.5) AS BIGINT) AS upper_cents FROM orders GROUP BY 1")
def medians(spark, d):
    """The median, and the upper median from exact ranks (no list of a group is built)."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.floor(F.median("o_totalprice") * 100 + 0.5).alias("median_cents"), F.floor(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -o_totalprice)") * -100 + 0.5).alias("upper_cents"))


@query("op_A25", """WITH l AS (SELECT l_orderkey AS cell, p_brand AS cluster, l_partkey % 50 AS gene, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT gene, count(*) AS cells, sum(q) AS total FROM l GROUP BY 1)
SELECT cluster, l.gene, count(*) AS n_in, t.cells - count(*) AS n_out, CAST(sum(q) AS BIGINT) AS sum_in, CAST(t.total - sum(q) AS BIGINT) AS sum_out FROM l JOIN t USING (gene) GROUP BY cluster, l.gene, t.cells, t.total""")
def markers(spark, d):
    """Counts inside each cluster; those outside are the totals less them, so the matrix is read once."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    cells = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cell"), F.col("p_brand").alias("cluster"), (F.col("l_partkey") % 50).alias("gene")).agg(F.sum("l_quantity").alias("q"))
    inside = cells.groupBy("cluster", "gene").agg(F.count("*").alias("n_in"), F.sum("q").alias("s"))
    all_ = Window.partitionBy("gene")
    return inside.select("cluster", "gene", "n_in", (F.sum("n_in").over(all_) - F.col("n_in")).alias("n_out"), F.col("s").cast("long").alias("sum_in"), (F.sum("s").over(all_) - F.col("s")).cast("long").alias("sum_out"))


@query("op_A26", "SELECT id, count(*) AS n FROM evidence_items GROUP BY id HAVING count(*) > 1")
def repeated(spark, d):
    return table(spark, d, "evidence_items").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("op_A27", "WITH s AS (SELECT DISTINCT task_id, unnest(source) AS s FROM llm_tasks) SELECT task_id, count(DISTINCT s.submitter) >= 2 OR bool_or(lower(s.review_status) LIKE '%expert%') AS several FROM s GROUP BY 1")
def derived(spark, d):
    s = table(spark, d, "llm_tasks").select("task_id", F.explode("source").alias("s"))
    return s.groupBy("task_id").agg(((F.count_distinct("s.submitter") >= 2) | F.bool_or(F.coalesce(F.lower("s.review_status").contains("expert"), F.lit(False)))).alias("several"))


@query("op_A28", "SELECT requested_use, count(DISTINCT case_id) AS asked, count(DISTINCT CASE WHEN adm IN ('admitted', 'review_required', 'rejected') THEN case_id END) AS answered, count(*) - count(DISTINCT case_id || '/' || reviewer_id) AS doubled FROM " + _A + " GROUP BY 1")
def completeness(spark, d):
    good = F.when(F.col("adm").isin("admitted", "review_required", "rejected"), F.col("case_id"))
    return notes(spark, d).groupBy("requested_use").agg(F.count_distinct("case_id").alias("asked"), F.count_distinct(good).alias("answered"), (F.count("*") - F.count_distinct(F.concat_ws("/", "case_id", "reviewer_id"))).alias("doubled"))


@query("op_A29", f"SELECT reviewer_id, count_if(adm = 'admitted' AND truth <> 'admitted') AS control_admitted, count(*) AS n FROM {_L} JOIN {_PRED} USING (case_id, requested_use) GROUP BY 1")
def controls(spark, d):
    return labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"]).groupBy("reviewer_id").agg(F.count_if((F.col("adm") == "admitted") & (F.col("truth") != "admitted")).alias("control_admitted"), F.count("*").alias("n"))


@query("op_A30", f"SELECT split, count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT group_id) AS groups, count(DISTINCT case_id || '/' || requested_use) AS units FROM {_A} GROUP BY 1")
def manifest(spark, d):
    return notes(spark, d).groupBy("split").agg(F.count_distinct("reviewer_id").alias("reviewers"), F.count_distinct("group_id").alias("groups"), F.count_distinct(F.concat_ws("/", "case_id", "requested_use")).alias("units"))


@query("op_A32", "WITH s AS (SELECT DISTINCT task_id, unnest(source) AS s FROM llm_tasks) SELECT task_id, string_agg(s.submitter || ':' || s.scv, '; ' ORDER BY s.submitter, s.scv) AS summary FROM s GROUP BY 1")
def summaries(spark, d):
    s = table(spark, d, "llm_tasks").select("task_id", F.explode("source").alias("s")).distinct().where("s.submitter is not null and s.scv is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("s.submitter", "s.scv"))), lambda x: F.concat_ws(":", x["submitter"], x["scv"]))
    return s.groupBy("task_id").agg(F.array_join(parts, "; ").alias("summary"))


@query("op_A33", f"WITH a AS (SELECT hgnc_id, unnest({SYMBOLS.format('alias_symbol')}) AS label FROM genes) SELECT label, count(DISTINCT hgnc_id) AS ids, CASE WHEN count(DISTINCT hgnc_id) > 1 THEN 'ambiguous' ELSE 'synonym' END AS stratum FROM a GROUP BY 1")
def label_strata(spark, d):
    a = table(spark, d, "genes").select("hgnc_id", F.explode(symbol_values(F.col("alias_symbol"))).alias("label"))
    n = F.count_distinct("hgnc_id")
    return a.groupBy("label").agg(n.alias("ids"), F.when(n > 1, "ambiguous").otherwise("synonym").alias("stratum"))


@query("op_A34", f"SELECT reviewer_id, count(*) AS calls, count_if(adm IS NOT NULL AND adm <> '') AS answered, CAST(floor(median(minutes_spent) * 100 + 0.5) AS BIGINT) AS median_hundredths FROM {_A} GROUP BY 1")
def runs(spark, d):
    return notes(spark, d).groupBy("reviewer_id").agg(F.count("*").alias("calls"), F.count_if(F.col("adm") != "").alias("answered"), F.floor(F.median("minutes_spent") * 100 + 0.5).alias("median_hundredths"))


@query("op_A35", f"SELECT count_if(flagged AND wrong) AS flagged_wrong, count_if(flagged AND NOT wrong) AS flagged_right, count_if(NOT flagged AND wrong) AS rest_wrong, count_if(NOT flagged AND NOT wrong) AS rest_right FROM {_RISK}")
def signal(spark, d):
    f, w = F.col("flagged"), F.col("wrong")
    return _risk(spark, d).agg(F.count_if(f & w).alias("flagged_wrong"), F.count_if(f & ~w).alias("flagged_right"), F.count_if(~f & w).alias("rest_wrong"), F.count_if(~f & ~w).alias("rest_right"))


QUERIES, ORACLES = query.queries, query.oracles
