"""Queries over ordered operations: top-k, sampling by keyed hash, dedup by preference, batching, shares."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hierarchy
from ..tables import cut, table
from .registry import Registry
from .statistics import _A, _L, labels, million, notes
from .texts import _ITEMS, items

query = Registry()


def top_by_hash(df, strata, id_col, n, salt):
    """The first `n` of each stratum in the order of a keyed hash. Each input partition keeps its own first `n` of a
    stratum before the exchange (a window group limit), so large strata don't meet whole in one task."""
    key = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(key, id_col))).where(F.col("_rank") <= n)


@query("op_W1", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s1' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def sampled(spark, d):
    return top_by_hash(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 5, "s1").select("source", "doc_id")


@query("op_W2", "SELECT cluster, gene, k FROM (SELECT cluster, gene, row_number() OVER (PARTITION BY cluster ORDER BY q DESC, gene) AS k FROM (SELECT p_brand AS cluster, l_partkey AS gene, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE k <= 10")
def top_genes(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("q"), "l_partkey"))
    return q.select(F.col("p_brand").alias("cluster"), F.col("l_partkey").alias("gene"), k.cast("long").alias("k")).where("k <= 10")


@query("op_W4", "SELECT l_orderkey, l_linenumber, min(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END * 1000000000 + l_partkey) % 1000000000 AS kept FROM lineitem GROUP BY ALL")
def preferred(spark, d):
    """Of repeated keys the preferred row, else the first: one aggregation, no sort."""
    order = F.struct((F.col("l_returnflag") != "A").alias("other"), "l_partkey")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(order)["l_partkey"].alias("kept"))


@query("op_W5", f"SELECT record_id, min(sha256(id) || id) AS chosen FROM {_ITEMS} GROUP BY 1")
def best(spark, d):
    return items(spark, d).groupBy("record_id").agg(F.min(F.concat(F.sha2("id", 256), "id")).alias("chosen"))


@query("op_W6", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY sha256('s6' || doc_id), doc_id) <= 10 THEN 'pilot' ELSE 'test' END AS part FROM documents")
def split(spark, d):
    """First ten of each source as pilot: a top-k join, so the rest is never sorted."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    pilot = top_by_hash(docs, ["source"], "doc_id", 10, "s6").select("doc_id", F.lit("pilot").alias("part"))
    return docs.select("doc_id").join(pilot, "doc_id", "left").select("doc_id", F.coalesce("part", F.lit("test")).alias("part"))


@query("op_W7", "WITH n AS (SELECT source, count_if(lang = 'en') AS cases FROM documents GROUP BY 1), c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s7' || doc_id), doc_id) AS k FROM documents WHERE lang <> 'en') SELECT c.source, c.doc_id FROM c JOIN n USING (source) WHERE k <= round_even(cases * 0.1, 0)")
def controls(spark, d):
    """The first k of each stratum in hash order with k from the data: ranks within 256 key ranges of a stratum, and the
    sizes of the ranges before from a small table, so that no stratum is sorted in one task."""
    docs = table(spark, d, "documents").select("source", "doc_id", "lang")
    n = docs.groupBy("source").agg(F.bround(F.count_if(F.col("lang") == "en") * 0.1).alias("wanted"))
    rest = docs.where("lang <> 'en'").select("source", "doc_id", F.sha2(F.concat(F.lit("s7"), F.col("doc_id").cast("string")), 256).alias("key")).withColumn("part", F.substring("key", 1, 2))
    sizes = rest.groupBy("source", "part").agg(F.count("*").alias("c"))
    ahead = sizes.select("source", "part", (F.sum("c").over(Window.partitionBy("source").orderBy("part")) - F.col("c")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("key", "doc_id"))
    return rest.withColumn("k", inside).join(ahead, ["source", "part"]).join(n, "source").where("ahead + k <= wanted").select("source", "doc_id")


@query("op_W8", "SELECT reviewer_id FROM (SELECT DISTINCT reviewer_id FROM reviewers) ORDER BY sha256('s8' || reviewer_id), reviewer_id LIMIT 10")
def drawn(spark, d, n=10):
    """A draw of `n` without replacement that anyone can repeat: the first in the order of a keyed hash, the same way at
    every size. (A seeded generator over sorted ids, as the reference has, would need all ids in one place; its draw
    differs.) A population of fewer than n is drawn whole."""
    ids = table(spark, d, "reviewers").select("reviewer_id").where("reviewer_id is not null").distinct()
    return ids.orderBy(F.sha2(F.concat(F.lit("s8"), "reviewer_id"), 256), "reviewer_id").limit(n)


def places(df, key, parts=32):
    """Adds `place`, the position (from 0) of each row in the order of a string key without nulls or repeats: rows are dealt into ranges
    of the key, ranked within, and each range adds the sizes of those before, from a table of one row a range."""
    ranged = df.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


@query("op_W9", "SELECT work_key FROM (SELECT work_key, row_number() OVER (ORDER BY work_key) AS k FROM (SELECT DISTINCT work_key FROM works WHERE work_key IS NOT NULL)) WHERE (k - 1) % 3 = 0")
def every_third(spark, d):
    return places(table(spark, d, "works").select("work_key").where("work_key is not null").distinct(), "work_key").where("place % 3 = 0").select("work_key")


HINTS, NEAR, BLOCK = 3, 0.75, 5000


def near_names(rest, names):
    """(k, name, score) of the names at least NEAR to each key, at most HINTS of each block of names; `rest` (k) against
    all names (name) in blocks of about BLOCK keys and names.

    Similarity is that of matching blocks of letters. Twice the letters two texts share at all, by their sum of lengths,
    is never less, so a matrix of letter counts leaves few pairs to compare."""
    salts, blocks = (F.lit(max(1, -(-df.count() // BLOCK))) for df in (rest, names))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = rest.withColumn("salt", F.pmod(F.hash("k"), salts)).withColumn("block", every(blocks))
    known = names.withColumn("block", F.pmod(F.hash("name"), blocks)).withColumn("salt", every(salts))

    def run(left, right):
        texts = right["name"].tolist()
        letters = sorted(set("".join(texts)))
        place = {c: n for n, c in enumerate(letters)}

        def row(text):
            out = np.zeros(len(letters), np.int32)
            for c in text:
                if c in place:
                    out[place[c]] += 1
            return out

        held = np.array([row(t) for t in texts], np.int32).reshape(len(texts), len(letters))
        sizes = np.array([len(t) for t in texts])
        found = []
        for k in left["k"]:
            most = 2 * np.minimum(held, row(k)).sum(axis=1) / np.maximum(sizes + len(k), 1)
            compare = difflib.SequenceMatcher(None, "", k)
            near = []
            for n in np.flatnonzero(most >= NEAR):
                compare.set_seq1(texts[n])
                if (score := compare.ratio()) >= NEAR:
                    near.append((score, texts[n]))
            found.extend((k, name, score) for score, name in sorted(near, reverse=True)[:HINTS])
        return pd.DataFrame(found, columns=["k", "name", "score"])

    return asked.groupBy("salt", "block").cogroup(known.groupBy("salt", "block")).applyInPandas(run, "k string, name string, score double")


@query("op_W10")
def hints(spark, d):
    """Up to three reference names for each name asked that is none: those with all its words, shortest first, else the
    most similar ones; '' if there are none (message text only; the mapping itself is p6).

    Names with all words are met over the word of the key that fewest names have, then tested for the others."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    names = table(spark, d, "ref_terms").where("not coalesce(obsolete, false)").select(T.label_key(F.col("name")).alias("name")).where("name <> ''").distinct()
    asked = table(spark, d, "name_queries").where("entity_type = 'cell_type' and query_text is not null").select("case_id", T.label_key(F.col("query_text")).alias("k")).distinct()
    keys = cut(asked.select("k").distinct().join(names, F.col("k") == F.col("name"), "left_anti"))
    by_word = names.select("name", F.explode(words(F.col("name"))).alias("word"))
    usual = by_word.groupBy("word").agg(F.count("*").alias("n"))
    each = keys.select("k", F.explode(words(F.col("k"))).alias("word")).join(usual, "word", "left")
    rarest = each.groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w")).where("w.n > 0").select("k", "w.word")
    wider = rarest.join(by_word, "word").where(F.size(F.array_except(words(F.col("k")), words(F.col("name")))) == 0).select("k", "name", F.length("name").alias("size"))
    top = lambda df, *order: df.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where(F.col("at") <= HINTS)
    wide = cut(top(wider, "size", "name").select("k", "name", "at"))
    near = top(near_names(keys.join(wide, "k", "left_anti").select("k"), names), F.desc("score"), F.desc("name")).select("k", "name", "at")
    told = wide.unionByName(near).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "; ").alias("hint"))
    return asked.join(keys, "k", "left_semi").join(told, "k", "left").select("case_id", F.coalesce("hint", F.lit("")).alias("hint"))


@query("op_W11", "SELECT DISTINCT work_key, array_to_string(list_filter(urls, lambda x, i: list_position(urls, x) = i), '|') AS urls FROM works WHERE urls IS NOT NULL")
def ordered_dedup(spark, d):
    """Repeated members go, the first of each keeps its place."""
    return table(spark, d, "works").where("urls is not null").select("work_key", F.array_join(F.array_distinct("urls"), "|").alias("urls")).distinct()


@query("op_W13", "SELECT record_id, array_to_string(list_slice(list_sort(list(DISTINCT id)), 1, 3), ', ') || CASE WHEN count(DISTINCT id) > 3 THEN ' and ' || (count(DISTINCT id) - 3) || ' more' ELSE '' END AS names FROM evidence_items GROUP BY 1")
def named_three(spark, d):
    ids = F.array_sort(F.collect_set("id"))
    more = F.when(F.size(ids) > 3, F.concat(F.lit(" and "), (F.size(ids) - 3).cast("string"), F.lit(" more"))).otherwise("")
    return table(spark, d, "evidence_items").groupBy("record_id").agg(F.concat(F.array_join(F.slice(ids, 1, 3), ", "), more).alias("names"))


@query("op_W14", "SELECT reviewer_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY reviewer_id) AS turn FROM reviewers")
def round_robin(spark, d):
    return table(spark, d, "reviewers").select("reviewer_id", "site_id", F.row_number().over(Window.partitionBy("site_id").orderBy("reviewer_id")).cast("long").alias("turn"))


@query("op_W15", "SELECT task_id, CAST(floor((row_number() OVER (ORDER BY task_id) - 1) / 25) AS BIGINT) AS batch FROM (SELECT DISTINCT task_id FROM llm_tasks WHERE task_id IS NOT NULL)")
def batches(spark, d):
    return places(table(spark, d, "llm_tasks").select("task_id").where("task_id is not null").distinct(), "task_id").select("task_id", F.floor(F.col("place") / 25).alias("batch"))


@query("op_W16", "WITH a AS (SELECT work_key, min(doc_id) AS doc_id FROM documents WHERE section = 'abstract' AND work_key IS NOT NULL GROUP BY 1), b AS (SELECT work_key, min(doc_id) AS doc_id FROM documents WHERE section = 'results' AND work_key IS NOT NULL AND work_key NOT IN (SELECT work_key FROM a) GROUP BY 1) SELECT 'abstract' AS category, * FROM a UNION ALL SELECT 'results', * FROM b")
def greedy(spark, d):
    docs = table(spark, d, "documents").where("work_key is not null").select("section", "work_key", "doc_id")
    first = lambda df: df.groupBy("work_key").agg(F.min("doc_id").alias("doc_id"))
    a = first(docs.where("section = 'abstract'"))
    b = first(docs.where("section = 'results'").join(a.select("work_key"), "work_key", "left_anti"))
    return a.select(F.lit("abstract").alias("category"), "work_key", "doc_id").unionByName(b.select(F.lit("results").alias("category"), "work_key", "doc_id"))


@query("op_W17", "SELECT source, CAST(floor(1000000.0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS share FROM documents GROUP BY 1")
def share_of_total(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", million(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("op_W18", "WITH s AS (SELECT DISTINCT task_id, unnest(source) AS s FROM llm_tasks) SELECT task_id, s.scv AS scv, row_number() OVER (PARTITION BY task_id ORDER BY s.submitter NULLS LAST, s.scv NULLS LAST, s.classification NULLS LAST, s.date_last_evaluated NULLS LAST, s.review_status NULLS LAST, s.collection_method NULLS LAST) AS n FROM s WHERE s IS NOT NULL")
def ordinals(spark, d):
    """Of all submissions, missing members last."""
    s = table(spark, d, "llm_tasks").select("task_id", F.explode("source").alias("s")).distinct().where("s is not null").select("task_id", "s.*")
    order = ("submitter", "scv", "classification", "date_last_evaluated", "review_status", "collection_method")
    n = F.row_number().over(Window.partitionBy("task_id").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return s.select("task_id", "scv", n.cast("long").alias("n"))


@query("op_W19", "SELECT id, CASE WHEN len(synonyms) > 3 THEN array_to_string(list_slice(synonyms, 1, 3), ', ') || ' et al.' ELSE array_to_string(synonyms, ', ') END AS named FROM ref_terms WHERE synonyms IS NOT NULL")
def et_al(spark, d):
    s = F.col("synonyms")
    return table(spark, d, "ref_terms").where(s.isNotNull()).select("id", F.when(F.size(s) > 3, F.concat(F.array_join(F.slice(s, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(s, ", ")).alias("named"))


# Graph joins over the same tables



@query("op_J10", "WITH RECURSIVE e AS (SELECT n_nationkey + 100 AS child, n_regionkey + 10 AS parent FROM nation UNION ALL SELECT r_regionkey + 10, 1 FROM region UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier), c(node, ancestor) AS (SELECT child, parent FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON e.child = c.ancestor) SELECT CAST(node AS BIGINT) AS node, CAST(ancestor AS BIGINT) AS ancestor FROM c")
def closure(spark, d):
    edge = lambda df, c, p: df.select((F.expr(c)).cast("string").alias("child"), F.expr(p).cast("string").alias("parent"))
    edges = edge(table(spark, d, "nation"), "n_nationkey + 100", "n_regionkey + 10").unionByName(edge(table(spark, d, "region"), "r_regionkey + 10", "1")).unionByName(edge(table(spark, d, "supplier"), "s_suppkey + 1000", "s_nationkey + 100"))
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    return hierarchy.closure(nodes, edges).where("node <> below").select(F.col("below").cast("long").alias("node"), F.col("node").cast("long").alias("ancestor"))


@query("op_J13", f"WITH a AS (SELECT case_id, requested_use, count(DISTINCT adm) AS k FROM {_L} GROUP BY ALL), j AS (SELECT case_id, requested_use, max(adm) AS adm FROM {_A} WHERE split = 'test' GROUP BY ALL) SELECT a.case_id, a.requested_use, CASE WHEN k = 1 THEN 'unanimous' WHEN j.case_id IS NOT NULL THEN 'adjudicated' ELSE 'open' END AS resolution FROM a LEFT JOIN j USING (case_id, requested_use)")
def resolved(spark, d):
    a = labels(spark, d).groupBy("case_id", "requested_use").agg(F.count_distinct("adm").alias("k"))
    j = notes(spark, d).where("split = 'test'").select("case_id", "requested_use", F.lit(True).alias("there")).distinct()
    return a.join(j, ["case_id", "requested_use"], "left").select("case_id", "requested_use", F.when(F.col("k") == 1, "unanimous").when(F.col("there"), "adjudicated").otherwise("open").alias("resolution"))


@query("op_J14", f"SELECT s.case_id, l.case_id IS NULL AS pending FROM (SELECT DISTINCT replace(task_id, 'task', 'case') AS case_id FROM llm_tasks) s LEFT JOIN (SELECT DISTINCT case_id FROM {_L}) l USING (case_id)")
def audited(spark, d):
    s = table(spark, d, "llm_tasks").select(F.replace("task_id", F.lit("task"), F.lit("case")).alias("case_id")).distinct()
    return s.join(labels(spark, d).select("case_id", F.lit(True).alias("there")).distinct(), "case_id", "left").select("case_id", F.col("there").isNull().alias("pending"))


@query("op_J20", "SELECT a.n_nationkey, min(b.n_nationkey) AS donor FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 3 <> 0 GROUP BY 1")
def donors(spark, d):
    n = table(spark, d, "nation")
    b = n.select(F.col("n_nationkey").alias("donor"), "n_regionkey")
    return n.join(b, "n_regionkey").where((F.col("n_nationkey") != F.col("donor")) & ((F.col("n_nationkey") + F.col("donor")) % 3 != 0)).groupBy("n_nationkey").agg(F.min("donor").alias("donor"))


@query("op_J22", f"SELECT a.reviewer_id AS m1, b.reviewer_id AS m2, count_if(a.adm = b.adm) AS same FROM {_L} a JOIN {_L} b ON a.case_id = b.case_id AND a.requested_use = b.requested_use AND a.reviewer_id < b.reviewer_id GROUP BY ALL")
def model_pairs(spark, d):
    from .statistics import pairs_of_reviewers

    return pairs_of_reviewers(spark, d).groupBy(F.col("r1").alias("m1"), F.col("r2").alias("m2")).agg(F.count_if(F.col("x") == F.col("y")).alias("same"))


@query("op_J25", "SELECT o_orderkey, coalesce(n_name, 'default') AS direction FROM orders LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3) ON o_custkey = c_custkey")
def curated(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation").where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("n_name", F.lit("default")).alias("direction"))


QUERIES, ORACLES = query.queries, query.oracles
