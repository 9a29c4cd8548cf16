"""Queries that compare claims with reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import findings as R
from ..operators import grounding as G
from ..tables import table
from .registry import Registry
from .relations import _FULL, full, joined_quotes
from .statistics import _A as _ADM
from .statistics import _L, _PRED, labels, majority
from .texts import _ITEMS, items

query = Registry()
_SYMBOL = "regexp_extract(locator, 'gene *= *\"?([A-Z0-9]+)', 1)"


@query("op_P15", """WITH c AS (SELECT id, unnest(parents) AS p FROM terms), t AS (SELECT id, bool_or(coalesce(obsolete, false)) AS obsolete FROM terms GROUP BY 1)
SELECT DISTINCT c.id AS child, c.p AS term_id, CASE WHEN NOT starts_with(c.p, 'XCT:') THEN 'prefix' WHEN t.id IS NULL THEN 'unknown' WHEN t.obsolete THEN 'obsolete' END AS code FROM c LEFT JOIN t ON t.id = c.p WHERE c.p IS NOT NULL""")
def terms(spark, d):
    t = table(spark, d, "terms")
    claims = t.select(F.col("id").alias("child"), F.explode("parents").alias("term_id"), F.lit(None).cast("string").alias("label")).where("term_id is not null").distinct()
    return G.term_checks(claims, t, "XCT").select("child", "term_id", "code")


@query("op_P16", f"""WITH c AS (SELECT DISTINCT {_SYMBOL} AS s FROM {_ITEMS} WHERE {_SYMBOL} <> '' UNION SELECT DISTINCT lower({_SYMBOL}) FROM {_ITEMS} WHERE {_SYMBOL} <> '' UNION SELECT symbol FROM genes WHERE status <> 'Approved')
SELECT s, CASE WHEN s IN (SELECT symbol FROM genes WHERE status = 'Approved') THEN NULL WHEN lower(s) IN (SELECT lower(symbol) FROM genes WHERE status = 'Approved') THEN 'case' ELSE 'unknown' END AS code FROM c""")
def symbols(spark, d):
    s = items(spark, d).select(F.regexp_extract("locator", 'gene *= *"?([A-Z0-9]+)', 1).alias("s")).where("s <> ''")
    genes = table(spark, d, "genes")
    claims = s.unionByName(s.select(F.lower("s").alias("s"))).unionByName(genes.where("status <> 'Approved'").select(F.col("symbol").alias("s"))).distinct()
    return G.symbol_checks(claims, genes, "s")


@query("op_P17", f"""WITH c AS (SELECT DISTINCT 'NC_000007.14:' || regexp_extract(locator, '(g\\.[0-9]+[A-Z]>[A-Z])', 1) AS h FROM {_ITEMS} WHERE regexp_matches(locator, 'g\\.[0-9]+[A-Z]>[A-Z]') UNION SELECT 'NC_000007:g.1A>T' UNION SELECT 'x' UNION SELECT 'NC_000099.1:g.1A>T' UNION SELECT 'NM_1.1:c.5A>T')
SELECT h, CASE WHEN h = 'x' THEN 'form' WHEN h LIKE 'NC_000007:%' THEN 'version' WHEN h LIKE 'NC_000099%' THEN 'unknown' WHEN h LIKE 'NC_000007.14%' AND CAST(regexp_extract(h, 'g\\.([0-9]+)', 1) AS BIGINT) > 50000 THEN 'beyond' END AS code FROM c""")
def variants(spark, d):
    made = items(spark, d).where(F.col("locator").rlike(r"g\.[0-9]+[A-Z]>[A-Z]")).select(F.concat(F.lit("NC_000007.14:"), F.regexp_extract("locator", r"(g\.[0-9]+[A-Z]>[A-Z])", 1)).alias("h"))
    more = spark.createDataFrame([("NC_000007:g.1A>T",), ("x",), ("NC_000099.1:g.1A>T",), ("NM_1.1:c.5A>T",)], "h string")
    sequences = spark.createDataFrame([("NC_000007.14", "GRCh38", 50_000)], "accession string, build string, length long")
    return G.variant_checks(made.unionByName(more).distinct(), "h", sequences, F.array().cast("array<string>"))


@query("op_P18", f"""WITH c AS (SELECT id, {_SYMBOL} AS s FROM {_ITEMS} WHERE {_SYMBOL} <> '') SELECT c.id AS claim, CASE WHEN count(g.hgnc_id) = 0 THEN 'none' WHEN count(g.hgnc_id) > 1 THEN 'many' WHEN bool_or(g.status <> 'Approved') THEN 'wrong' END AS code FROM c LEFT JOIN genes g ON lower(g.symbol) = lower(c.s) GROUP BY 1""")
def table_rows(spark, d):
    """Does the cited row exist once, and is its status as claimed?"""
    s = items(spark, d).select(F.col("id").alias("claim"), F.regexp_extract("locator", 'gene *= *"?([A-Z0-9]+)', 1).alias("s")).where("s <> ''")
    claims = s.select("claim", F.inline(F.array(F.struct(F.lit("key").alias("kind"), F.lit("symbol").alias("column"), F.col("s").alias("value")), F.struct(F.lit("value").alias("kind"), F.lit("status").alias("column"), F.lit("Approved").alias("value")))))
    rows = table(spark, d, "genes").select(F.col("hgnc_id").alias("row"), "symbol", "status").unpivot("row", ["symbol", "status"], "column", "value")
    return G.row_checks(claims, rows, ["symbol", "status"])


@query("op_P19", """SELECT DISTINCT work_key, CASE WHEN NOT regexp_matches(work_key, '^(pmid:[0-9]+|doi:10[.].+)$') THEN 'identifier' WHEN metadata_sha256 IS NULL THEN 'unpinned' WHEN fulltext_sha256 IS NULL AND abstract_sha256 IS NULL THEN 'no_text' WHEN license IS NULL THEN 'licence' END AS code FROM works""")
def sources(spark, d):
    w = table(spark, d, "works")
    code = G.cascade((T.identifier(F.col("work_key")).isNull(), "identifier"), (F.col("metadata_sha256").isNull(), "unpinned"), (F.col("fulltext_sha256").isNull() & F.col("abstract_sha256").isNull(), "no_text"), (F.col("license").isNull(), "licence"))
    return w.select("work_key", code.alias("code")).distinct()


@query("op_P20", f"""WITH q AS (SELECT id, source_artifact_id, regexp_replace(coalesce(extracted_text, ''), '[.]? *[(][^()]*[)][.]?$', '') AS quote FROM {_ITEMS}), h AS (SELECT q.id, bool_or(d.work_key = q.source_artifact_id) AS own FROM q JOIN documents d ON contains(d.text, q.quote) WHERE len(string_split(q.quote, ' ')) >= 5 GROUP BY 1)
SELECT q.id, CASE WHEN quote = '' THEN 'no_text' WHEN len(string_split(quote, ' ')) < 5 THEN 'short' WHEN h.id IS NULL THEN 'absent' WHEN NOT coalesce(h.own, false) THEN 'elsewhere' END AS code FROM q LEFT JOIN h USING (id)""")
def quote_checks(spark, d):
    q = items(spark, d).select("id", "source_artifact_id", F.regexp_replace(F.coalesce("extracted_text", F.lit("")), "[.]? *[(][^()]*[)][.]?$", "").alias("quote"))
    docs = table(spark, d, "documents")
    hits = joined_quotes(q.select("id", "quote"), docs.select("doc_id", "text")).join(docs.select("doc_id", "work_key"), "doc_id").join(q.select("id", "source_artifact_id"), "id")
    own = hits.groupBy("id").agg(F.bool_or(F.col("work_key") == F.col("source_artifact_id")).alias("own"), F.lit(True).alias("hit"))
    code = G.cascade((F.col("quote") == "", "no_text"), (F.size(F.split("quote", " ")) < T.MIN_QUOTE_WORDS, "short"), (F.col("hit").isNull(), "absent"), (~F.coalesce("own", F.lit(False)), "elsewhere"))
    return q.join(own, "id", "left").select("id", code.alias("code"))


@query("op_P22", "WITH a AS (SELECT DISTINCT p_brand AS s, s_nationkey AS o, l_returnflag AS p FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) SELECT DISTINCT x.s, x.o FROM a x JOIN a y ON x.s = y.s AND x.o = y.o AND x.p = 'A' AND y.p = 'R'")
def opposites(spark, d):
    """Subject and object pairs held with a predicate and its opposite, from one grouping."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    a = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = a.groupBy(F.col("p_brand").alias("s"), F.col("s_nationkey").alias("o")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("x"), F.bool_or(F.col("l_returnflag") == "R").alias("y"))
    return g.where("x and y").select("s", "o")


@query("op_P23", "WITH m AS (SELECT l_orderkey AS c, p_type AS g, max(l_discount) AS pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT c, CAST(count(*) AS BIGINT) AS measured, arg_max(g, (pct, g)) AS highest FROM m GROUP BY 1 HAVING max(pct) < 0.03")
def definitions(spark, d):
    """Groups all of whose measurements lie below the threshold, with the highest of them."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = li.groupBy(F.col("l_orderkey").alias("c"), F.col("p_type").alias("g")).agg(F.max("l_discount").alias("pct"))
    return m.groupBy("c").agg(F.count("*").alias("measured"), F.max_by("g", F.struct("pct", "g")).alias("highest"), F.max("pct").alias("top")).where("top < 0.03").drop("top")


_UP = """WITH RECURSIVE n AS (SELECT DISTINCT id FROM terms), e AS (SELECT DISTINCT t.id AS child, n.id AS parent FROM (SELECT id, unnest(parents) AS p FROM terms) t JOIN n ON n.id = 'XCT:' || regexp_extract(upper(t.p), 'XCT[:_]\\s*([0-9]+)', 1)),
u(node, up) AS (SELECT id, id FROM n UNION SELECT u.node, e.parent FROM u JOIN e ON e.child = u.up)"""


@query("op_F29", _UP + """, t AS (SELECT id, bool_or(coalesce(obsolete, false)) AS obsolete, max(substr(id, 5)) AS k FROM terms GROUP BY 1), a AS (SELECT id AS truth, up AS answer FROM (SELECT node AS id, min(up) AS up FROM u GROUP BY 1) UNION SELECT min(up), node FROM u GROUP BY node)
SELECT a.truth, a.answer, CASE WHEN t.obsolete THEN 'invalid' WHEN a.truth = a.answer THEN 'exact' WHEN EXISTS (SELECT 1 FROM u WHERE u.node = a.truth AND u.up = a.answer) THEN 'coarser' WHEN EXISTS (SELECT 1 FROM u WHERE u.node = a.answer AND u.up = a.truth) THEN 'finer' ELSE 'wrong' END AS outcome FROM a JOIN t ON t.id = a.answer""")
def outcome(spark, d):
    from ..operators import hierarchy

    t = table(spark, d, "terms")
    up = hierarchy.descendants(t).groupBy(F.col("descendant").alias("truth")).agg(F.min("ancestor").alias("answer"))
    return G.outcome_class(up.unionByName(up.select(F.col("answer").alias("truth"), F.col("truth").alias("answer"))).distinct(), t)


@query("op_J10d")
def disjoint(spark, d):
    t = table(spark, d, "terms")
    pairs = t.select(F.col("id").alias("a"), F.explode("disjoint").alias("b")).where("b is not null").distinct()
    return G.declared_disjoint(pairs, t)


@query("op_F30", f"SELECT id, array_to_string(list_filter([CASE WHEN source_artifact_id NOT LIKE 'pmid:%' THEN 'no_pmid' END, CASE WHEN NOT human THEN 'not_human' END, CASE WHEN agent_type IS NULL THEN 'no_author' END], lambda x: x IS NOT NULL), '|') AS problems FROM {_FULL}")
def problems(spark, d):
    some = F.array(F.when(~F.col("source_artifact_id").startswith("pmid:"), "no_pmid"), F.when(~F.col("human"), "not_human"), F.when(F.col("agent_type").isNull(), "no_author"))
    return full(spark, d).select("id", F.array_join(F.filter(some, lambda x: x.isNotNull()), "|").alias("problems"))


@query("op_A18", f"WITH s AS (SELECT l.reviewer_id, count_if(truth <> 'admitted') AS neg, count_if(truth <> 'admitted' AND adm = 'admitted') AS fa, count_if(truth = 'admitted') AS pos, count_if(truth = 'admitted' AND adm <> 'admitted') AS fb FROM {_L} l JOIN {_PRED} p USING (case_id, requested_use) GROUP BY 1) SELECT reviewer_id, fa, neg, CAST(floor(10000.0 * fb / pos + 0.5) AS BIGINT) AS block FROM s WHERE neg > 0 AND pos > 0")
def rule_inputs(spark, d):
    s = labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"])
    y, t = F.col("adm") == "admitted", F.col("truth") == "admitted"
    g = s.groupBy("reviewer_id").agg(F.count_if(~t).alias("neg"), F.count_if(~t & y).alias("fa"), F.count_if(t).alias("pos"), F.count_if(t & ~y).alias("fb")).where("neg > 0 and pos > 0")
    return g.select("reviewer_id", "fa", "neg", F.floor(10000 * F.col("fb") / F.col("pos") + 0.5).alias("block"))


@query("op_A31")
def census(spark, d):
    """Whether the census rate of an error lies within the audit's interval and below its exact bound."""
    s = labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"]).select("reviewer_id", "case_id", (F.col("adm") != F.col("truth")).alias("wrong"))
    both = s.groupBy("reviewer_id").agg(F.avg(F.col("wrong").cast("int")).alias("census"), F.count_if(F.pmod(F.xxhash64("case_id"), F.lit(2)) == 0).alias("n"), F.count_if(F.col("wrong") & (F.pmod(F.xxhash64("case_id"), F.lit(2)) == 0)).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return both.where("n > 0").select("reviewer_id", F.col("census").between(low, high).alias("within"), (F.col("census") <= S.exact_bounds("k", "n")).alias("below"))


@query("op_A23", f"SELECT l.reviewer_id, count(*) AS n, count_if(adm = truth) AS correct, count_if(adm = 'review_required') AS stopped, count_if(adm = 'review_required' AND truth = 'admitted') AS false_stop FROM {_L} l JOIN {_PRED} p USING (case_id, requested_use) GROUP BY 1")
def metrics(spark, d):
    s = labels(spark, d).join(majority(spark, d), ["case_id", "requested_use"])
    stop = F.col("adm") == "review_required"
    return s.groupBy("reviewer_id").agg(F.count("*").alias("n"), F.count_if(F.col("adm") == F.col("truth")).alias("correct"), F.count_if(stop).alias("stopped"), F.count_if(stop & (F.col("truth") == "admitted")).alias("false_stop"))


@query("op_J19", f"WITH c AS (SELECT DISTINCT id, source_artifact_id AS w, {_SYMBOL} AS g FROM {_ITEMS} WHERE {_SYMBOL} <> '' AND evidence_type = 'table_row'), k AS (SELECT DISTINCT source_artifact_id AS w, {_SYMBOL} AS g FROM {_ITEMS} WHERE {_SYMBOL} <> '' AND evidence_type = 'publication_quote') SELECT c.id, EXISTS (SELECT 1 FROM k WHERE k.w = c.w AND k.g = c.g) AS curated FROM c")
def curated_match(spark, d):
    e = items(spark, d).select("id", F.col("source_artifact_id").alias("w"), F.regexp_extract("locator", 'gene *= *"?([A-Z0-9]+)', 1).alias("g"), "evidence_type").where("g <> ''")
    known = e.where("evidence_type = 'publication_quote'").select("w", "g", F.lit(True).alias("k")).distinct()
    return e.where("evidence_type = 'table_row'").select("id", "w", "g").distinct().join(known, ["w", "g"], "left").select("id", F.coalesce("k", F.lit(False)).alias("curated"))


@query("op_C4", f"WITH v AS (SELECT DISTINCT record_id, source_artifact_id, extracted_text FROM {_ITEMS} WHERE evidence_type = 'publication_quote' AND extraction_method = 'parser' AND extracted_text IS NOT NULL), s AS (SELECT DISTINCT record_id, source_artifact_id, extracted_text FROM {_ITEMS} WHERE extraction_method = 'llm_extraction' AND extracted_text IS NOT NULL) SELECT record_id, source_artifact_id, sha256(extracted_text) AS quote FROM v ANTI JOIN s USING (record_id, source_artifact_id, extracted_text)")
def carried_citations(spark, d):
    key = ["record_id", "source_artifact_id", "quote"]
    e = items(spark, d).where("extracted_text is not null").withColumn("quote", F.sha2("extracted_text", 256))
    return e.where("evidence_type = 'publication_quote' and extraction_method = 'parser'").select(*key).distinct().join(e.where("extraction_method = 'llm_extraction'").select(*key), key, "left_anti")


@query("op_R14", "SELECT DISTINCT id, 'evidence ' || regexp_extract(id, '0*([0-9]+)$', 1) || CASE WHEN locator IS NULL THEN '' ELSE ' (' || locator || ')' END AS named FROM evidence_items")
def named(spark, d):
    return items(spark, d).select("id", F.concat(F.lit("evidence "), F.regexp_extract("id", "0*([0-9]+)$", 1), F.when(F.col("locator").isNull(), "").otherwise(F.concat(F.lit(" ("), "locator", F.lit(")")))).alias("named"))


@query("op_P30", "SELECT DISTINCT episode_id, list_sort(json_keys(payload)) = ['attempts', 'calls', 'model', 'task_id'] AS shaped FROM episodes WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'")
def shapes(spark, d):
    keys = F.array_sort(F.json_object_keys("payload"))
    good = table(spark, d, "episodes").where(F.try_parse_json("payload").isNotNull())
    return good.select("episode_id", (keys == F.array(*[F.lit(k) for k in ("attempts", "calls", "model", "task_id")])).alias("shaped")).where("shaped is not null").distinct()


@query("op_R2", f"SELECT id, len(ps) AS n FROM (SELECT id, list_filter(string_split(locator, ';'), lambda x: instr(x, '=') > 0) AS ps FROM {_ITEMS} WHERE locator IS NOT NULL)")
def fields(spark, d):
    return items(spark, d).where("locator is not null").select("id", F.size(F.filter(F.split("locator", ";"), lambda x: F.instr(x, "=") > 0)).cast("long").alias("n"))


@query("op_R22", f"SELECT case_id, requested_use, reviewer_id AS method, adm AS predicted_status, CASE WHEN requested_use = 'expert_panel' THEN 'divergent' ELSE 'control' END AS subset FROM {_L}")
def as_predictions(spark, d):
    return labels(spark, d).select("case_id", "requested_use", F.col("reviewer_id").alias("method"), F.col("adm").alias("predicted_status"), F.when(F.col("requested_use") == "expert_panel", "divergent").otherwise("control").alias("subset"))


@query("op_P14", "SELECT DISTINCT e.id, CASE WHEN w.h IS NULL THEN 'absent' WHEN left(w.h, 1) < '4' THEN 'mismatch' END AS code FROM evidence_items e LEFT JOIN (SELECT work_key, max(fulltext_sha256) AS h FROM works GROUP BY 1) w ON w.work_key = e.source_artifact_id")
def source_bytes(spark, d):
    """Are the bytes of the item's source at hand, and are they those expected? (Here a digest's first digit stands in.)"""
    w = table(spark, d, "works").groupBy(F.col("work_key").alias("source_artifact_id")).agg(F.max("fulltext_sha256").alias("h"))
    e = table(spark, d, "evidence_items").select("id", "source_artifact_id").distinct().join(w, "source_artifact_id", "left")
    return e.select("id", G.cascade((F.col("h").isNull(), "absent"), (F.substring("h", 1, 1) < "4", "mismatch")).alias("code"))


@query("op_P25", f"WITH a AS (SELECT record_id, source_artifact_id, count(*) AS x FROM {_ITEMS} WHERE evidence_type = 'table_row' GROUP BY ALL), b AS (SELECT record_id, source_artifact_id, count(*) AS y FROM {_ITEMS} WHERE extraction_method = 'parser' GROUP BY ALL) SELECT record_id, source_artifact_id, CASE WHEN y IS NULL THEN 'unknown' WHEN x IS NULL THEN 'omitted' WHEN x <> y THEN 'differs' END AS code FROM a FULL JOIN b USING (record_id, source_artifact_id)")
def rebuilt(spark, d):
    """What a record holds against what the source rebuilds: full outer join and an ordered case."""
    key = ["record_id", "source_artifact_id"]
    e = items(spark, d)
    a = e.where("evidence_type = 'table_row'").groupBy(*key).agg(F.count("*").alias("x"))
    b = e.where("extraction_method = 'parser'").groupBy(*key).agg(F.count("*").alias("y"))
    return a.join(b, key, "full").select(*key, G.cascade((F.col("y").isNull(), "unknown"), (F.col("x").isNull(), "omitted"), (F.col("x") != F.col("y"), "differs")).alias("code"))


@query("op_P28", f"WITH u AS (SELECT case_id, requested_use, count(*) AS k FROM {_L} GROUP BY ALL) SELECT t.task_id, u.k IS NULL AS unreviewed FROM (SELECT DISTINCT task_id, replace(task_id, 'task', 'case') AS case_id FROM llm_tasks) t LEFT JOIN (SELECT case_id, sum(k) AS k FROM u GROUP BY 1) u USING (case_id)")
def linked(spark, d):
    u = labels(spark, d).groupBy("case_id").agg(F.count("*").alias("k"))
    t = table(spark, d, "llm_tasks").select("task_id", F.replace("task_id", F.lit("task"), F.lit("case")).alias("case_id")).distinct()
    return t.join(u, "case_id", "left").select("task_id", F.col("k").isNull().alias("unreviewed"))


@query("op_P33", "SELECT doc_id, CASE WHEN work_key IS NULL THEN 'no_work' WHEN work_key NOT IN (SELECT work_key FROM works WHERE work_key IS NOT NULL) THEN 'not_found' WHEN section IS NULL THEN 'no_section' WHEN lang <> 'en' OR lang IS NULL THEN 'unverifiable' ELSE 'found' END AS category FROM documents")
def categories(spark, d):
    w = table(spark, d, "works").select("work_key", F.lit(True).alias("there")).distinct()
    j = table(spark, d, "documents").select("doc_id", "work_key", "section", "lang").join(w, "work_key", "left")
    code = G.cascade((F.col("work_key").isNull(), "no_work"), (F.col("there").isNull(), "not_found"), (F.col("section").isNull(), "no_section"), (F.coalesce(F.col("lang") != "en", F.lit(True)), "unverifiable"))
    return j.select("doc_id", F.coalesce(code, F.lit("found")).alias("category"))


@query("op_P35", "WITH s AS (SELECT DISTINCT task_id, unnest(source) AS s FROM llm_tasks) SELECT task_id, max(CASE WHEN lower(s.review_status) LIKE '%expert%' THEN 3 WHEN lower(s.review_status) LIKE '%criteria%' THEN 1 ELSE 0 END) AS stars FROM s GROUP BY 1")
def stars(spark, d):
    s = table(spark, d, "llm_tasks").select("task_id", F.explode("source.review_status").alias("r"))
    r = F.lower("r")
    return s.groupBy("task_id").agg(F.max(F.when(r.contains("expert"), 3).when(r.contains("criteria"), 1).otherwise(0)).alias("stars"))


@query("op_R6", "WITH s AS (SELECT DISTINCT task_id, unnest(source) AS s FROM llm_tasks) SELECT task_id, s.scv AS item_id, CASE WHEN lower(s.classification) LIKE '%pathogenic%' THEN 'supports' WHEN lower(s.classification) LIKE '%benign%' THEN 'contradicts' ELSE 'neutral' END AS direction FROM s WHERE s.scv IS NOT NULL GROUP BY ALL")
def submissions(spark, d):
    """A record's items from its submissions, with the direction of each."""
    s = table(spark, d, "llm_tasks").select("task_id", F.explode("source").alias("s")).where("s.scv is not null")
    c = F.lower("s.classification")
    return s.select("task_id", F.col("s.scv").alias("item_id"), F.when(c.contains("pathogenic"), "supports").when(c.contains("benign"), "contradicts").otherwise("neutral").alias("direction")).distinct()


@query("op_R9", f"SELECT record_id, extraction_method AS stance, array_to_string(list_sort(list(id)), '|') AS line FROM {_ITEMS} GROUP BY ALL")
def lines(spark, d):
    return items(spark, d).groupBy("record_id", F.col("extraction_method").alias("stance")).agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("line"))


@query("op_R19", f"SELECT annotation_id, CASE WHEN adm = map THEN 'accept' WHEN adm IS NULL OR map IS NULL THEN NULL ELSE 'defer' END AS decision FROM {_ADM}")
def readings(spark, d):
    from .statistics import notes

    return notes(spark, d).select("annotation_id", F.when(F.col("adm") == F.col("map"), "accept").when(F.col("adm").isNull() | F.col("map").isNull(), None).otherwise("defer").alias("decision"))


@query("op_W12", "SELECT id, array_to_string(list_sort(synonyms), '|') AS ordered FROM ref_terms WHERE synonyms IS NOT NULL")
def ordered(spark, d):
    return table(spark, d, "ref_terms").where("synonyms is not null").select("id", F.array_join(F.array_sort("synonyms"), "|").alias("ordered"))


QUERIES, ORACLES = query.queries, query.oracles
