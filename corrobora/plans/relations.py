"""Queries over rules, joins, set operations, record construction and recorded loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings as R
from ..operators import hierarchy
from ..operators.timestamps import step
from ..tables import cut, table
from .registry import Registry
from .statistics import _A, _L, labels, notes
from .texts import _ITEMS, cue_sql, items

query = Registry()
CONTRACTS = {"research_summary": ["publication_quote"], "clinical_report": ["publication_quote", "table_row"], "expert_panel": ["criteria_application", "publication_quote"]}
_CONTRACT = "(VALUES ('research_summary', 'publication_quote'), ('clinical_report', 'publication_quote'), ('clinical_report', 'table_row'), ('expert_panel', 'criteria_application'), ('expert_panel', 'publication_quote')) AS c(use, required_type)"
_FULL = "(SELECT DISTINCT id, record_id, source_artifact_id, evidence_type, extraction_method, list_contains(coalesce(scope, []), 'NCBITaxon:9606') AS human, created_by.agent_type AS agent_type FROM evidence_items)"


def full(spark, d):
    e = table(spark, d, "evidence_items")
    human = F.array_contains(F.coalesce("scope", F.array().cast("array<string>")), "NCBITaxon:9606")
    return e.select("id", "record_id", "source_artifact_id", "evidence_type", "extraction_method", human.alias("human"), F.col("created_by.agent_type").alias("agent_type")).distinct()


def records(spark, d):
    return table(spark, d, "evidence_items").select("record_id").distinct()


@query("op_P21", f"SELECT id FROM {_ITEMS} WHERE {cue_sql(T.NEGATION)}")
def negated(spark, d):
    return items(spark, d).where(T.has_cue(F.col("extracted_text"), T.NEGATION)).select("id")


@query("op_P27", f"SELECT annotation_id, 'label' AS problem FROM {_A} WHERE coalesce(adm, '') NOT IN ('admitted', 'review_required', 'rejected') UNION ALL SELECT min(annotation_id), 'twice' FROM {_A} GROUP BY case_id, requested_use, reviewer_id HAVING count(DISTINCT annotation_id) > 1")
def protocol(spark, d):
    a = notes(spark, d)
    bad = a.where(~F.coalesce(F.col("adm"), F.lit("")).isin("admitted", "review_required", "rejected")).select("annotation_id", F.lit("label").alias("problem"))
    twice = a.groupBy("case_id", "requested_use", "reviewer_id").agg(F.count_distinct("annotation_id").alias("n"), F.min("annotation_id").alias("annotation_id")).where("n > 1").select("annotation_id", F.lit("twice").alias("problem"))
    return bad.unionByName(twice)


# Joins


@query("op_J1", "SELECT DISTINCT e.id, e.record_id, w.resolver FROM evidence_items e JOIN works w ON e.source_artifact_id = w.work_key")
def chain(spark, d):
    w = table(spark, d, "works").select("work_key", "resolver").distinct()
    return table(spark, d, "evidence_items").select("id", "record_id", "source_artifact_id").distinct().join(w, F.col("source_artifact_id") == F.col("work_key")).select("id", "record_id", "resolver").distinct()


@query("op_J2", "SELECT DISTINCT d.doc_id, w.work_key IS NULL AS without_work FROM documents d LEFT JOIN works w USING (work_key)")
def with_or_without(spark, d):
    w = table(spark, d, "works").select("work_key", F.lit(True).alias("there")).distinct()
    return table(spark, d, "documents").select("doc_id", "work_key").join(w, "work_key", "left").select("doc_id", F.col("there").isNull().alias("without_work"))


@query("op_J3", "SELECT DISTINCT e.id FROM evidence_items e ANTI JOIN documents d ON d.work_key = e.source_artifact_id")
def absent(spark, d):
    return table(spark, d, "evidence_items").select("id", F.col("source_artifact_id").alias("work_key")).distinct().join(table(spark, d, "documents"), "work_key", "left_anti").select("id")


@query("op_J4", f"SELECT r.record_id, c.use, count(*) AS required FROM (SELECT DISTINCT record_id FROM evidence_items) r CROSS JOIN {_CONTRACT} GROUP BY ALL")
def contracts(spark, d):
    return records(spark, d).select("record_id", F.inline(R.contract_column(CONTRACTS))).groupBy("record_id", "use").agg(F.count("required_type").alias("required"))


@query("op_J5", f"SELECT r.record_id, c.use, c.required_type, count(e.id) AS n FROM (SELECT DISTINCT record_id FROM evidence_items) r CROSS JOIN {_CONTRACT} LEFT JOIN {_FULL} e ON e.record_id = r.record_id AND e.evidence_type = c.required_type GROUP BY ALL")
def per_type(spark, d):
    have = full(spark, d).groupBy("record_id", F.col("evidence_type").alias("required_type")).agg(F.count("*").alias("n"))
    asked = records(spark, d).select("record_id", F.inline(R.contract_column(CONTRACTS)))
    return asked.join(have, ["record_id", "required_type"], "left").select("record_id", "use", "required_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("op_J6", "WITH l AS (SELECT id, 0 AS k, lower(name) AS label FROM ref_terms WHERE NOT obsolete UNION ALL SELECT id, 1, lower(s) FROM (SELECT id, unnest(synonyms) AS s FROM ref_terms WHERE NOT obsolete)), q AS (SELECT DISTINCT case_id, lower(trim(query_text)) AS label FROM name_queries) SELECT case_id, count(DISTINCT id) AS n_terms, arg_min(id, id) AS first_term FROM q JOIN l USING (label) GROUP BY 1")
def label_terms(spark, d):
    t = table(spark, d, "ref_terms").where("not obsolete")
    names = t.select("id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("label")).select("id", F.lower("label").alias("label")).distinct()
    q = table(spark, d, "name_queries").select("case_id", F.lower(F.trim("query_text")).alias("label")).distinct()
    return q.join(names, "label").groupBy("case_id").agg(F.count_distinct("id").alias("n_terms"), F.min("id").alias("first_term"))


@query("op_J7", """WITH k AS (SELECT p_partkey, p_size, p_retailprice FROM part) SELECT l.p_partkey AS asked, count(*) AS matches FROM (SELECT p_partkey, p_size, floor(p_retailprice * 10) / 10 AS claim FROM part) l JOIN k ON l.p_size = k.p_size AND abs(l.claim - k.p_retailprice) <= 0.15 GROUP BY 1""")
def tolerant(spark, d):
    """Tolerance join of all claims, as an equality join on neighbouring buckets of the value, with the exact test behind
    it."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    asked = p.select(F.col("p_partkey").alias("asked"), "p_size", (F.floor(F.col("p_retailprice") * 10) / 10).alias("claim"))
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("claim")) - 1, F.floor(F.col("claim")) + 1)))
    rows = p.select("p_size", "p_retailprice", F.floor("p_retailprice").alias("bucket"))
    return asked.join(rows, ["p_size", "bucket"]).where(F.abs(F.col("claim") - F.col("p_retailprice")) <= 0.15).groupBy("asked").agg(F.count("*").alias("matches"))


_QUOTE = "regexp_replace(extracted_text, '[.]? *[(][^()]*[)][.]?$', '')"


@query("op_J8", f"SELECT e.id, count(DISTINCT d.doc_id) AS n_docs FROM (SELECT id, source_artifact_id, {_QUOTE} AS quote FROM {_ITEMS}) e JOIN documents d ON contains(d.text, e.quote) WHERE len(string_split(e.quote, ' ')) >= 5 GROUP BY 1")
def quotes(spark, d):
    e = items(spark, d).select("id", F.regexp_replace("extracted_text", "[.]? *[(][^()]*[)][.]?$", "").alias("quote"))
    return joined_quotes(e, table(spark, d, "documents").select("doc_id", "text")).groupBy("id").agg(F.count_distinct("doc_id").alias("n_docs"))


def joined_quotes(e, docs):
    """(id, doc_id) of quotes (id, quote) contained in documents (doc_id, text). Quotes of fewer than five words are
    refused. A document holds a quote only if it holds all runs of three words inside it (the quote itself may start and stop inside
    a word); each different quote is looked up by the run that fewest documents have, then tested on the whole texts."""
    runs = lambda w, first, last: F.array_distinct(F.transform(F.sequence(first, last), lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1), F.get(w, k + 2))))
    e = e.where("quote is not null").withColumn("q", F.xxhash64("quote", F.length("quote")))
    quotes = step(e.select("q", "quote").distinct(), w=F.split("quote", " ")).where(F.size("w") >= T.MIN_QUOTE_WORDS)
    quotes = cut(quotes.select("q", "quote", runs(F.col("w"), F.lit(1), F.size("w") - 4).alias("runs")))
    docs = docs.where("text is not null")
    held = step(docs.select("doc_id", "text"), w=F.split("text", " ")).where(F.size("w") >= 3).select("doc_id", F.explode(runs(F.col("w"), F.lit(0), F.size("w") - 3)).alias("key"))
    asked = quotes.select("q", F.size("runs").alias("need"), F.explode("runs").alias("key"))
    held = cut(held.join(asked.select("key").distinct(), "key", "left_semi"))
    usual = held.groupBy("key").agg(F.count("*").alias("n"))
    best = asked.join(usual, "key").groupBy("q").agg(F.count("*").alias("met"), F.first("need").alias("need"), F.min_by("key", "n").alias("key")).where("met = need").select("q", "key")
    pairs = best.join(held, "key").join(quotes.select("q", "quote"), "q").select("q", "quote", F.col("doc_id").alias("of"))
    true = pairs.join(docs.select("doc_id", "text"), (F.col("of") == F.col("doc_id")) & F.contains("text", "quote")).select("quote", "doc_id")
    return e.select("id", "quote").join(true, "quote").select("id", "doc_id")


@query("op_J9", "SELECT s_nationkey, bool_and(p_size > 1) AS all_larger FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def for_all(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("s_nationkey").agg(F.bool_and(F.col("p_size") > 1).alias("all_larger"))


@query("op_J11")
def inherited(spark, d):
    """Relations of a term and of all its ancestors, by a walk down from the terms that have any."""
    t = table(spark, d, "terms")
    own = t.select(F.col("id").alias("ancestor"), F.explode("relations").alias("r")).select("ancestor", "r.rel", "r.target").distinct()
    below = hierarchy.under(own.select(F.col("ancestor").alias("node")).distinct(), cut(hierarchy.term_edges(t)[1]))
    return below.withColumnRenamed("start", "ancestor").join(own, "ancestor").select(F.col("node").alias("term_id"), "rel", "target").distinct()


@query("op_J12", f"SELECT l.reviewer_id, l.case_id, l.requested_use, t.source IS NULL AS without_task FROM {_L} l LEFT JOIN (SELECT DISTINCT replace(task_id, 'task', 'case') AS case_id, true AS source FROM llm_tasks) t USING (case_id)")
def predictions(spark, d):
    t = table(spark, d, "llm_tasks").select(F.replace("task_id", F.lit("task"), F.lit("case")).alias("case_id"), F.lit(True).alias("source")).distinct()
    return labels(spark, d).join(t, "case_id", "left").select("reviewer_id", "case_id", "requested_use", F.col("source").isNull().alias("without_task"))


@query("op_J15", "WITH a AS (SELECT c_custkey, c_nationkey FROM customer), b AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1) SELECT c_custkey, c_nationkey, last IS NOT NULL AS later FROM a LEFT JOIN b ON c_custkey = o_custkey")
def two_releases(spark, d):
    b = table(spark, d, "orders").where("o_orderdate >= timestamp '1996-01-01'").select("o_custkey").distinct().withColumn("later", F.lit(True))
    return table(spark, d, "customer").join(b, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("later", F.lit(False)).alias("later"))


@query("op_J16", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) l ON l_orderkey = o_orderkey")
def semi(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("op_J17", f"""WITH a AS (SELECT case_id, requested_use, max(adm) AS x FROM {_L} GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT case_id, requested_use, min(adm) AS y FROM {_L} GROUP BY ALL HAVING count(*) <= 5)
SELECT case_id, requested_use, CASE WHEN y IS NULL THEN 'fabricated' WHEN x IS NULL THEN 'omitted' WHEN x = y THEN 'exact' ELSE 'misstated' END AS outcome FROM a FULL JOIN b USING (case_id, requested_use)""")
def outcomes(spark, d):
    g = labels(spark, d).groupBy("case_id", "requested_use").agg(F.count("*").alias("n"), F.max("adm").alias("x"), F.min("adm").alias("y"))
    a, b = g.where("n >= 5").select("case_id", "requested_use", "x"), g.where("n <= 5").select("case_id", "requested_use", "y")
    x, y = F.col("x"), F.col("y")
    return a.join(b, ["case_id", "requested_use"], "full").select("case_id", "requested_use", F.when(y.isNull(), "fabricated").when(x.isNull(), "omitted").when(x == y, "exact").otherwise("misstated").alias("outcome"))


@query("op_J18", f"SELECT l.requested_use, k.cut, count_if(n >= k.cut) AS passed FROM (SELECT requested_use, case_id, count(*) AS n FROM {_L} GROUP BY ALL) l CROSS JOIN (VALUES (2), (3), (4)) AS k(cut) GROUP BY ALL")
def configurations(spark, d):
    return labels(spark, d).groupBy("requested_use", "case_id").agg(F.count("*").alias("n")).select("*", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("cut")).groupBy("requested_use", "cut").agg(F.count_if(F.col("n") >= F.col("cut")).alias("passed"))


@query("op_J21", f"SELECT a.reviewer_id AS r1, b.reviewer_id AS r2, count(*) AS units FROM {_L} a JOIN {_L} b ON a.case_id = b.case_id AND a.requested_use = b.requested_use AND a.reviewer_id < b.reviewer_id GROUP BY ALL")
def self_pairs(spark, d):
    from .statistics import pairs_of_reviewers

    return pairs_of_reviewers(spark, d).groupBy("r1", "r2").agg(F.count("*").alias("units"))


@query("op_J23", "SELECT r_regionkey, v.k AS level, v.x AS name FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN LATERAL (VALUES ('region', r_name), ('nation', n_name)) AS v(k, x) GROUP BY ALL")
def unpivoted(spark, d):
    both = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return both.unpivot("r_regionkey", ["region", "nation"], "level", "name").distinct()


@query("op_J24", "SELECT DISTINCT e.id, w.work_key, d.doc_id IS NOT NULL AS has_document FROM (SELECT DISTINCT id, source_artifact_id FROM evidence_items) e JOIN (SELECT DISTINCT work_key FROM works) w ON w.work_key = e.source_artifact_id LEFT JOIN (SELECT work_key, min(doc_id) AS doc_id FROM documents GROUP BY 1) d ON d.work_key = w.work_key")
def library_chain(spark, d):
    e = table(spark, d, "evidence_items").select("id", F.col("source_artifact_id").alias("work_key")).distinct()
    docs = table(spark, d, "documents").groupBy("work_key").agg(F.min("doc_id").alias("doc_id"))
    return e.join(table(spark, d, "works").select("work_key").distinct(), "work_key").join(docs, "work_key", "left").select("id", "work_key", F.col("doc_id").isNotNull().alias("has_document"))


# Sets


@query("op_U2", f"SELECT id FROM {_ITEMS} WHERE locator LIKE '#%' UNION SELECT id FROM {_ITEMS} WHERE evidence_type = 'table_row'")
def verified_union(spark, d):
    e = items(spark, d)
    return e.where("locator like '#%'").select("id").unionByName(e.where("evidence_type = 'table_row'").select("id")).distinct()


@query("op_U3", "SELECT work_key FROM works EXCEPT SELECT work_key FROM documents")
def difference(spark, d):
    return table(spark, d, "works").select("work_key").exceptAll(table(spark, d, "documents").select("work_key")).distinct().join(table(spark, d, "documents").select("work_key").where("work_key is not null"), "work_key", "left_anti")


@query("op_U4", "SELECT DISTINCT id, len(list_intersect(coalesce(scope, []), ['NCBITaxon:9606', 'assay:bulk'])) > 0 AS overlaps FROM evidence_items")
def overlaps(spark, d):
    return table(spark, d, "evidence_items").select("id", F.coalesce(F.arrays_overlap("scope", F.array(F.lit("NCBITaxon:9606"), F.lit("assay:bulk"))), F.lit(False)).alias("overlaps")).distinct()


@query("op_U5", "SELECT DISTINCT id, list_has_all(['NCBITaxon:9606', 'cohort:adult'], coalesce(scope, [])) AS within FROM evidence_items")
def within(spark, d):
    return table(spark, d, "evidence_items").select("id", (F.size(F.array_except(F.coalesce("scope", F.array().cast("array<string>")), F.array(F.lit("NCBITaxon:9606"), F.lit("cohort:adult")))) == 0).alias("within")).distinct()


@query("op_U6", f"SELECT case_id FROM {_L} GROUP BY 1 HAVING count(DISTINCT requested_use) = 2")
def common(spark, d):
    return labels(spark, d).groupBy("case_id").agg(F.count_distinct("requested_use").alias("n")).where("n = 2").select("case_id")


@query("op_U8", f"SELECT case_id FROM {_A} WHERE split = 'test' INTERSECT SELECT case_id FROM {_A} WHERE split = 'development'")
def leaked(spark, d):
    a = notes(spark, d)
    return a.where("split = 'test'").select("case_id").intersect(a.where("split = 'development'").select("case_id"))


# Record construction


@query("op_R1", f"SELECT record_id, count(*) AS n_items, string_agg(id || '@' || coalesce(locator, ''), ';' ORDER BY id) AS lines FROM {_ITEMS} GROUP BY 1")
def built(spark, d):
    rows = items(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("id", F.concat_ws("@", "id", F.coalesce("locator", F.lit(""))).alias("t")))).alias("x"))
    return rows.select("record_id", F.size("x").cast("long").alias("n_items"), F.array_join(F.transform("x", lambda x: x["t"]), ";").alias("lines"))


@query("op_R3", f"SELECT id, 'draft-' || left(sha256(record_id || '|' || coalesce(locator, '')), 16) AS made_id FROM {_ITEMS}")
def content_ids(spark, d):
    return items(spark, d).select("id", F.concat(F.lit("draft-"), T.digest(F.concat("record_id", F.lit("|"), F.coalesce("locator", F.lit(""))), 16)).alias("made_id"))


@query("op_R10", "SELECT DISTINCT e.id, coalesce(w.h, 'unpinned') AS pinned FROM evidence_items e LEFT JOIN (SELECT work_key, max(coalesce(fulltext_sha256, abstract_sha256, metadata_sha256)) AS h FROM works GROUP BY 1) w ON w.work_key = e.source_artifact_id")
def pinned(spark, d):
    w = table(spark, d, "works").groupBy(F.col("work_key").alias("source_artifact_id")).agg(F.max(F.coalesce("fulltext_sha256", "abstract_sha256", "metadata_sha256")).alias("h"))
    return table(spark, d, "evidence_items").select("id", "source_artifact_id").distinct().join(w, "source_artifact_id", "left").select("id", F.coalesce("h", F.lit("unpinned")).alias("pinned"))


@query("op_R11", "SELECT id, k.fault, CASE k.fault WHEN 'negate' THEN regexp_replace(name, ' ', ' not ') WHEN 'drop' THEN regexp_replace(name, '^[^ ]+ ', '') ELSE upper(name) END AS edited FROM ref_terms CROSS JOIN (VALUES ('negate'), ('drop'), ('case')) AS k(fault)")
def faults(spark, d):
    """Every fault kind applied to every row: a stated list of few kinds, exploded beside the row."""
    kinds = F.explode(F.array(F.lit("negate"), F.lit("drop"), F.lit("case"))).alias("fault")
    f, name = F.col("fault"), F.col("name")
    first = F.concat(F.substring_index(name, " ", 1), F.lit(" not "), F.regexp_replace(name, "^[^ ]* ", ""))
    return table(spark, d, "ref_terms").select("id", "name", kinds).select("id", "fault", F.when(f == "negate", F.when(F.instr(name, " ") > 0, first).otherwise(name)).when(f == "drop", F.regexp_replace(name, "^[^ ]+ ", "")).otherwise(F.upper("name")).alias("edited"))


@query("op_R12", "WITH a AS (SELECT DISTINCT case_id FROM annotations) SELECT a.case_id, count(DISTINCT t.task_id) AS answers FROM a LEFT JOIN llm_tasks t ON replace(t.task_id, 'task', 'case') = a.case_id GROUP BY 1")
def expanded(spark, d):
    t = table(spark, d, "llm_tasks").select(F.replace("task_id", F.lit("task"), F.lit("case")).alias("case_id"), "task_id").distinct()
    return table(spark, d, "annotations").select("case_id").distinct().join(t, "case_id", "left").groupBy("case_id").agg(F.count_distinct("task_id").alias("answers"))


@query("op_R13", f"SELECT annotation_id, v.k AS field, v.x AS label FROM {_A} CROSS JOIN LATERAL (VALUES ('adm', adm), ('map', map)) AS v(k, x) WHERE v.x <> ''")
def sheet(spark, d):
    return notes(spark, d).unpivot("annotation_id", ["adm", "map"], "field", "label").where("label <> ''")


@query("op_R20", "SELECT DISTINCT task_id, CASE WHEN len(source) = 0 THEN 'none' WHEN len(list_distinct(list_transform(source, lambda s: s.classification))) > 1 THEN 'dissent' ELSE 'agreed' END AS category, CAST(('0x' || left(sha256(task_id), 8)) AS BIGINT) % 1000 AS made FROM llm_tasks WHERE source IS NOT NULL")
def categories(spark, d):
    n = F.size(F.array_distinct(F.filter("source.classification", lambda c: c.isNotNull())))
    return table(spark, d, "llm_tasks").where("source is not null").select("task_id", F.when(F.size("source") == 0, "none").when(n > 1, "dissent").otherwise("agreed").alias("category"), (F.conv(F.substring(F.sha2("task_id", 256), 1, 8), 16, 10).cast("long") % 1000).alias("made")).distinct()


@query("op_R21", "SELECT n_nationkey, CAST(unnest(range(0, CAST(n AS BIGINT))) AS INTEGER) AS k FROM (SELECT n_nationkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)")
def repeated_rows(spark, d):
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("int").alias("n"))
    return n.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))


# Recorded loops


_EV = "(SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query("op_C5", "SELECT DISTINCT task_id FROM llm_tasks ANTI JOIN (SELECT DISTINCT replace(case_id, 'case', 'task') AS t FROM annotations) a ON t = task_id")
def unfinished(spark, d):
    done = table(spark, d, "annotations").select(F.replace("case_id", F.lit("case"), F.lit("task")).alias("task_id"))
    return table(spark, d, "llm_tasks").select("task_id").distinct().join(done, "task_id", "left_anti")


@query("op_C7", f"SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM {_EV} GROUP BY 1")
def revisions(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


QUERIES, ORACLES = query.queries, query.oracles
