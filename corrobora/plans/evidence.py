"""Evidence records made of the supplied tables, and the rule set over them.

Items are those of the tables. What the tables don't hold is drawn from digests of ids, the same way in both engines:
the direction of an item, the state of a statement, and a few broken references, altered digests and unknown uses, so
that every rule meets records that break it. Reviews are the annotations of the case with the record's number; those of
trainees stand for reviews by software.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as R
from ..operators import rules
from ..tables import cut, table
from .registry import Registry
from .statistics import _A, notes

query = Registry()

#: The profile as rows: use, required types, verified types, human, independent, llm_only, match_only.
CONTRACTS = [
    ("research_summary", ["publication_quote"], ["publication_quote"], False, False, True, False),
    ("clinical_report", ["publication_quote", "table_row"], ["table_row"], False, True, False, False),
    ("expert_panel", [], [], True, False, False, False),
]
ALLOWED = [("predicates", "associated_with"), ("subject_types", "gene"), ("object_types", "disease")]
CODES = {"P1": ["SCHEMA"], "P2": ["RECORD_INTEGRITY"], "P3": ["BEV001"], "P4": ["BEV002"], "P5": ["BEV003"], "P6": ["BEV004"], "P7": ["BEV005"], "P8": ["BEV006"], "P9": ["BEV007"], "P10": ["BEV020"], "P11": ["BEV008", "BEV009", "BEV013"], "P12": ["BEV021"], "P13": ["BEV010", "BEV011", "BEV012"]}


def digit(salt, *parts, n=1):
    return F.substring(F.sha2(F.concat(F.lit(salt), *parts), 256), 1, n)


def profile(spark):
    contracts = spark.createDataFrame(CONTRACTS, "use string, required array<string>, verified array<string>, human boolean, independent boolean, llm_only boolean, match_only boolean")
    return contracts, spark.createDataFrame(ALLOWED, "field string, value string")


def records(spark, d) -> dict:
    """The tables of the rule set (operators/rules.py)."""
    e = table(spark, d, "evidence_items")
    items = cut(e.select("record_id", F.col("id").alias("item_id"), F.col("source_artifact_id").alias("source_id"), F.col("evidence_type").alias("kind"), F.col("extraction_method").alias("method"), F.coalesce("scope", F.array().cast("array<string>")).alias("scope"), F.col("created_by.id").alias("author"), "locator", F.col("extracted_text").alias("text")).where("record_id is not null and item_id is not null").distinct())
    r = F.col("record_id")
    s = items.groupBy("record_id").agg(F.min_by("scope", "item_id").alias("scope"), F.min_by("author", "item_id").alias("author"))
    statements = s.select("record_id", F.concat(F.lit("statement-"), r).alias("statement_id"), F.when(digit("s", r) == "0", "rejected").when(digit("s", r) == "1", "superseded").otherwise("proposed").alias("status"), F.when(digit("p", r) == "0", "other").otherwise("associated_with").alias("predicate"), F.lit("gene").alias("subject_type"), F.when(digit("o", r) == "0", "organ").otherwise("disease").alias("object_type"), "scope", "author")
    i, w = F.col("item_id"), F.col("source_id")
    direction = F.when(digit("d", i).isin("0", "1"), "contradicts").when(digit("d", i) == "2", "neutral").otherwise("supports")
    refs = items.select("record_id", F.concat_ws("/", "record_id", direction).alias("line_id"), direction.alias("direction"), F.when(digit("x", i, n=2) == "00", F.concat(i, F.lit("-gone"))).otherwise(i).alias("item_id"))
    frozen = table(spark, d, "works").groupBy(F.col("work_key").alias("source_id")).agg(F.max("metadata_sha256").alias("frozen"))
    sources = items.where(digit("a", r, w, n=2) != "00").select("record_id", "source_id").distinct().join(frozen, "source_id", "left").select("record_id", "source_id", "frozen", F.when(F.col("frozen").startswith("0"), F.reverse("frozen")).otherwise(F.col("frozen")).alias("observed"))
    asked = F.array(*[F.lit(c[0]) for c in CONTRACTS])
    uses = s.select("record_id", F.explode(F.when(digit("u", r, n=2) == "00", F.concat(asked, F.array(F.lit("unlisted")))).otherwise(asked)).alias("use"))
    a = table(spark, d, "annotations").select("annotation_id", F.col("reviewer_qualification").alias("q")).distinct()
    adm = notes(spark, d).where(F.col("adm").isin("admitted", "review_required", "rejected")).select("annotation_id", F.concat(F.lit("bioev:record-"), F.substring("case_id", 6, 100)).alias("record_id"), "requested_use", "reviewer_id", "adm")
    decision = F.when(F.col("adm") == "admitted", "accept").when(F.col("adm") == "rejected", "reject").otherwise("defer")
    reviews = adm.join(a, "annotation_id").join(s.select("record_id"), "record_id", "left_semi").select("record_id", F.col("annotation_id").alias("review_id"), F.concat(F.when(digit("w", F.col("annotation_id"), n=2) == "00", "other-").otherwise("statement-"), F.col("record_id")).alias("statement_id"), F.col("requested_use").alias("use"), decision.alias("decision"), F.col("reviewer_id").alias("reviewer"), F.when(F.col("q") == "trainee", "software").otherwise("human").alias("agent"))
    return {"items": items, "statements": statements, "refs": refs, "sources": sources, "uses": uses, "reviews": cut(reviews)}


def grounders(spark, d) -> list[rules.Grounder]:
    """Two grounders: table rows whose gene is an approved symbol are verified, others (renamed, withdrawn or unknown) don't exist; quotes
    of works whose text is at hand are verified, those of retracted ones (none licensed) can't be confirmed."""

    def genes(t):
        rows = t["items"].where("kind = 'table_row'").select("record_id", "item_id", F.regexp_extract("locator", 'gene *= *"?([A-Za-z0-9-]+)', 1).alias("symbol")).where("symbol <> ''")
        known = table(spark, d, "genes").where("status = 'Approved'").select("symbol", F.lit(True).alias("there")).distinct()
        return rows.join(known, "symbol", "left").select("record_id", "item_id", F.when(F.col("there").isNull(), "BEV016").alias("rule_id"), F.lit("error").alias("severity"))

    def texts(t):
        held = table(spark, d, "works").groupBy(F.col("work_key").alias("source_id")).agg(F.max(F.coalesce("fulltext_sha256", "abstract_sha256")).alias("held"))
        rows = t["items"].where("kind = 'publication_quote'").select("record_id", "item_id", "source_id").join(held, "source_id", "left")
        return rows.select("record_id", "item_id", F.when(F.col("held").isNull(), "BEV015").alias("rule_id"), F.lit("review").alias("severity"))

    return [rules.Grounder("genes", genes), rules.Grounder("texts", texts)]


def found(spark, d):
    return rules.findings(records(spark, d), *profile(spark), grounders(spark, d))


_H = lambda salt, x, n=1: f"substr(sha256('{salt}' || {x}), 1, {n})"
_SQL = f"""WITH i AS (SELECT DISTINCT record_id, id AS item_id, source_artifact_id AS source_id, evidence_type AS kind, extraction_method AS method, coalesce(scope, []) AS scope, created_by.id AS author, locator, extracted_text AS text FROM evidence_items WHERE record_id IS NOT NULL AND id IS NOT NULL),
s AS (SELECT record_id, 'statement-' || record_id AS statement_id, arg_min(scope, item_id) AS scope, arg_min(author, item_id) FILTER (author IS NOT NULL OR true) AS author0, CASE {_H('s', 'record_id')} WHEN '0' THEN 'rejected' WHEN '1' THEN 'superseded' ELSE 'proposed' END AS status, CASE {_H('p', 'record_id')} WHEN '0' THEN 'other' ELSE 'associated_with' END AS predicate, CASE {_H('o', 'record_id')} WHEN '0' THEN 'organ' ELSE 'disease' END AS object_type FROM i GROUP BY record_id),
r AS (SELECT record_id, CASE WHEN {_H('d', 'item_id')} IN ('0', '1') THEN 'contradicts' WHEN {_H('d', 'item_id')} = '2' THEN 'neutral' ELSE 'supports' END AS direction, CASE WHEN {_H('x', 'item_id', 2)} = '00' THEN item_id || '-gone' ELSE item_id END AS item_id FROM i),
f AS (SELECT work_key AS source_id, max(metadata_sha256) AS frozen FROM works GROUP BY 1),
c AS (SELECT x.record_id, x.source_id, frozen, CASE WHEN frozen LIKE '0%' THEN reverse(frozen) ELSE frozen END AS observed FROM (SELECT DISTINCT record_id, source_id FROM i WHERE {_H('a', 'record_id || source_id', 2)} <> '00') x LEFT JOIN f USING (source_id)),
k(use, required, verified, human, independent, llm_only, match_only) AS (VALUES ('research_summary', ['publication_quote'], ['publication_quote'], false, false, true, false), ('clinical_report', ['publication_quote', 'table_row'], ['table_row'], false, true, false, false), ('expert_panel', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), true, false, false, false)),
u AS (SELECT record_id, use FROM s CROSS JOIN k UNION ALL SELECT record_id, 'unlisted' FROM s WHERE {_H('u', 'record_id', 2)} = '00'),
w AS (SELECT 'bioev:record-' || substr(case_id, 6) AS record_id, annotation_id, requested_use AS use, reviewer_id AS reviewer, CASE adm WHEN 'admitted' THEN 'accept' WHEN 'rejected' THEN 'reject' ELSE 'defer' END AS decision, CASE WHEN q = 'trainee' THEN 'software' ELSE 'human' END AS agent FROM (SELECT DISTINCT annotation_id, case_id, requested_use, reviewer_id, adm FROM {_A} WHERE adm IN ('admitted', 'review_required', 'rejected')) JOIN (SELECT DISTINCT annotation_id, reviewer_qualification AS q FROM annotations) USING (annotation_id) WHERE 'bioev:record-' || substr(case_id, 6) IN (SELECT record_id FROM s)),
schema_ AS (SELECT record_id FROM i WHERE trim(coalesce(locator, '')) = '' UNION ALL SELECT record_id FROM i WHERE trim(coalesce(kind, '')) = '' UNION ALL SELECT record_id FROM i WHERE trim(coalesce(method, '')) = ''),
links AS (SELECT record_id FROM i GROUP BY record_id, item_id HAVING count(*) > 1 UNION ALL SELECT record_id FROM i WHERE len(list_distinct(scope)) < len(scope) UNION ALL SELECT record_id FROM s WHERE len(list_distinct(scope)) < len(scope)
UNION ALL SELECT record_id FROM i ANTI JOIN c USING (record_id, source_id) UNION ALL SELECT record_id FROM r GROUP BY record_id, direction, item_id HAVING count(*) > 1 UNION ALL SELECT record_id FROM r ANTI JOIN i USING (record_id, item_id)
UNION ALL SELECT record_id FROM u ANTI JOIN k USING (use) UNION ALL SELECT record_id FROM w ANTI JOIN k USING (use) UNION ALL SELECT record_id FROM w WHERE {_H('w', 'annotation_id', 2)} = '00'),
v AS (SELECT record_id, item_id FROM i WHERE kind = 'table_row' AND regexp_extract(locator, 'gene *= *"?([A-Za-z0-9-]+)', 1) IN (SELECT symbol FROM genes WHERE status = 'Approved') UNION SELECT record_id, item_id FROM i JOIN works ON work_key = source_id WHERE kind = 'publication_quote' AND coalesce(fulltext_sha256, abstract_sha256) IS NOT NULL),
g AS (SELECT record_id, 'BEV016' AS rule_id, 'error' AS severity FROM i WHERE kind = 'table_row' AND regexp_extract(locator, 'gene *= *"?([A-Za-z0-9-]+)', 1) NOT IN (SELECT symbol FROM genes WHERE status = 'Approved' UNION SELECT '') UNION ALL SELECT record_id, 'BEV015', 'review' FROM i WHERE kind = 'publication_quote' AND NOT EXISTS (SELECT 1 FROM works WHERE work_key = source_id AND coalesce(fulltext_sha256, abstract_sha256) IS NOT NULL)),
p AS (SELECT r.record_id, i.item_id, i.kind, i.method, list_sort(list_distinct(i.scope)) = list_sort(list_distinct(s.scope)) AS same FROM r JOIN i USING (record_id, item_id) JOIN s USING (record_id) WHERE direction = 'supports'),
h AS (SELECT DISTINCT record_id, item_id, kind, method FROM p WHERE same AND kind IS NOT NULL),
a AS (SELECT u.record_id, u.use, k.* EXCLUDE (use), coalesce((SELECT list(DISTINCT kind) FROM h WHERE h.record_id = u.record_id), []) AS types FROM u JOIN k USING (use)),
m AS (SELECT a.record_id, a.use, a.llm_only, a.match_only, list_sort(list(DISTINCT h.method)) AS ms FROM a JOIN h USING (record_id) JOIN (SELECT use, unnest(CASE WHEN len(required) = 0 THEN [''] ELSE required END) AS need FROM k) n ON n.use = a.use AND (n.need = '' OR n.need = h.kind) GROUP BY a.record_id, a.use, a.llm_only, a.match_only, n.need),
o AS (SELECT record_id, author FROM i WHERE author IS NOT NULL),
y AS (SELECT u.record_id, u.use, bool_or(agent = 'human' AND decision = 'accept') AS acc, bool_or(agent = 'human' AND decision = 'reject') AS rej, bool_or(agent = 'human' AND decision = 'defer') AS def, list_sort(list(DISTINCT decision) FILTER (agent <> 'human' AND reviewer NOT IN (SELECT author FROM o WHERE o.record_id = u.record_id))) AS others FROM u LEFT JOIN w ON w.record_id = u.record_id AND w.use = u.use GROUP BY ALL),
z AS (SELECT record_id, 'BEV001' AS rule_id, 'error' AS severity, NULL AS use FROM s WHERE status IN ('rejected', 'superseded') UNION ALL SELECT record_id, 'BEV002', 'error', NULL FROM c WHERE observed <> '' AND observed <> frozen UNION ALL SELECT record_id, 'BEV003', 'error', NULL FROM s WHERE predicate <> 'associated_with' UNION ALL SELECT record_id, 'BEV003', 'error', NULL FROM s WHERE object_type <> 'disease'
UNION ALL SELECT DISTINCT record_id, 'BEV004', 'review', NULL FROM r WHERE direction = 'contradicts' UNION ALL SELECT record_id, 'BEV005', 'error', NULL FROM p WHERE NOT same UNION ALL SELECT record_id, 'BEV006', 'review', NULL FROM s ANTI JOIN h USING (record_id)
UNION ALL SELECT record_id, 'BEV007', 'error', use FROM a WHERE NOT list_has_all(types, required) UNION ALL SELECT record_id, 'BEV020', 'review', use FROM (SELECT record_id, use, types, unnest(verified) AS kind FROM a) q WHERE list_contains(types, kind) AND NOT EXISTS (SELECT 1 FROM h JOIN v USING (record_id, item_id) WHERE h.record_id = q.record_id AND h.kind = q.kind)
UNION ALL SELECT record_id, CASE WHEN ms = ['llm_extraction'] THEN 'BEV008' WHEN ms = ['string_match'] THEN 'BEV009' ELSE 'BEV013' END, 'review', use FROM m WHERE ms = ['llm_extraction'] AND NOT llm_only OR ms = ['string_match'] AND NOT match_only OR ms = ['llm_extraction', 'string_match'] AND NOT (llm_only AND match_only)
UNION ALL SELECT record_id, 'BEV010', 'error', use FROM y JOIN k USING (use) WHERE human AND NOT coalesce(acc, false) UNION ALL SELECT record_id, 'BEV011', 'error', use FROM y JOIN k USING (use) WHERE rej UNION ALL SELECT record_id, 'BEV012', 'review', use FROM y JOIN k USING (use) WHERE def UNION ALL SELECT record_id, 'BEV021', 'review', use FROM y JOIN k USING (use) WHERE independent AND NOT coalesce(others = ['accept'], false)
UNION ALL SELECT record_id, rule_id, severity, NULL FROM g),
x AS (SELECT record_id, 'SCHEMA' AS rule_id, 'error' AS severity, NULL AS use FROM schema_ UNION ALL SELECT record_id, 'RECORD_INTEGRITY', 'error', NULL FROM links WHERE record_id NOT IN (SELECT record_id FROM schema_) UNION ALL SELECT * FROM z WHERE record_id NOT IN (SELECT record_id FROM schema_ UNION SELECT record_id FROM links)),
n AS (SELECT record_id, rule_id, severity, use, count(*) AS n FROM x GROUP BY ALL),
dec AS (SELECT u.record_id, u.use, CASE coalesce(max(CASE n.severity WHEN 'error' THEN 2 WHEN 'review' THEN 1 END), 0) WHEN 2 THEN 'rejected' WHEN 1 THEN 'review_required' ELSE 'admitted' END AS status, coalesce(array_to_string(list_sort(list(DISTINCT n.rule_id) FILTER (n.rule_id IS NOT NULL)), '|'), '') AS reason_codes FROM u LEFT JOIN n ON n.record_id = u.record_id AND (n.use IS NULL OR n.use = u.use) GROUP BY u.record_id, u.use)
"""


def _of(codes):
    return lambda spark, d: found(spark, d).where(F.col("rule_id").isin(codes)).select("record_id", "rule_id", "use", "n")


for _name, _codes in CODES.items():
    query(f"op_{_name}", _SQL + f"SELECT record_id, rule_id, use, n FROM n WHERE rule_id IN ({', '.join(repr(c) for c in _codes)})")(_of(_codes))


def decisions(spark, d):
    t = records(spark, d)
    return R.decide(rules.findings(t, *profile(spark), grounders(spark, d)), t["uses"].distinct())


query("op_decide", _SQL + "SELECT * FROM dec")(decisions)


@query("op_P31", _SQL + "SELECT record_id, CASE max(CASE status WHEN 'rejected' THEN 2 WHEN 'review_required' THEN 1 ELSE 0 END) WHEN 2 THEN 'rejected' WHEN 1 THEN 'review_required' ELSE 'admitted' END AS overall FROM dec GROUP BY 1")
def overall(spark, d):
    return R.overall(decisions(spark, d))


@query("op_U1", _SQL + "SELECT rule_id, severity, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL")
def counted(spark, d):
    return found(spark, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n_records"), F.sum("n").alias("n"))


#: Rules that go to a person as they are, judgments and policy.
EXPERT = ("BEV004", "BEV008", "BEV009", "BEV010", "BEV011", "BEV012", "BEV013", "BEV021", "BEV022", "BEV025")
_EXPERT = ", ".join(repr(c) for c in EXPERT)


@query("op_C3", _SQL + f"SELECT record_id, bool_and(rule_id IN ({_EXPERT})) AND bool_or(status <> 'admitted') AS to_expert, coalesce(array_to_string(list_sort(list(DISTINCT rule_id) FILTER (rule_id NOT IN ({_EXPERT}))), '|'), '') AS fed_back FROM n JOIN (SELECT record_id, max(CASE WHEN status = 'admitted' THEN 'admitted' ELSE 'open' END) AS status FROM dec GROUP BY 1) USING (record_id) GROUP BY record_id")
def to_expert(spark, d):
    """A record goes to a person if all its findings are such that its author can't mend them; others are fed back."""
    mine = F.col("rule_id").isin(*EXPERT)
    return found(spark, d).groupBy("record_id").agg(F.bool_and(mine).alias("to_expert"), F.array_join(F.array_sort(F.collect_set(F.when(~mine, F.col("rule_id")))), "|").alias("fed_back"))


QUALITY = ("BEV008", "BEV009", "BEV013")


@query("op_P32", _SQL + """, old AS (SELECT record_id, rule_id, severity, use FROM n WHERE rule_id NOT IN ('BEV008', 'BEV009', 'BEV013') UNION ALL SELECT record_id, 'AGGREGATE', 'review', NULL FROM h WHERE record_id NOT IN (SELECT record_id FROM schema_ UNION SELECT record_id FROM links) GROUP BY record_id HAVING bool_and(method IN ('llm_extraction', 'string_match')))
SELECT u.record_id, u.use, CASE coalesce(max(CASE o.severity WHEN 'error' THEN 2 WHEN 'review' THEN 1 END), 0) WHEN 2 THEN 'rejected' WHEN 1 THEN 'review_required' ELSE 'admitted' END AS status FROM u LEFT JOIN old o ON o.record_id = u.record_id AND (o.use IS NULL OR o.use = u.use) GROUP BY u.record_id, u.use""")
def aggregate_gate(spark, d):
    """The older gate: one finding if all supporting evidence together is weak, instead of one per required type; decided anew."""
    t = records(spark, d)
    now = cut(rules.findings(t, *profile(spark), grounders(spark, d)))
    stopped = now.where("rule_id in ('SCHEMA', 'RECORD_INTEGRITY')").select("record_id")
    weak = rules.supports(t)[0].where("kind is not null").groupBy("record_id").agg(F.bool_and(F.col("method").isin(*rules.WEAK.values())).alias("weak")).where("weak").join(stopped, "record_id", "left_anti")
    old = now.where(~F.col("rule_id").isin(*QUALITY)).drop("n").unionByName(weak.select("record_id", F.lit("AGGREGATE").alias("rule_id"), F.lit("review").alias("severity"), F.lit(None).cast("string").alias("use")))
    return R.decide(old, t["uses"].distinct()).drop("reason_codes")


@query("op_R17", _SQL + ", rep AS (SELECT record_id, string_agg(use || '=' || status || '(' || reason_codes || ')', '; ' ORDER BY use) AS decisions FROM dec GROUP BY 1) SELECT rep.record_id, decisions, coalesce(CAST(sum(n) AS BIGINT), 0) AS n_findings, NOT coalesce(bool_or(rule_id = 'SCHEMA'), false) AS schema_valid FROM rep LEFT JOIN n USING (record_id) GROUP BY ALL")
def reports(spark, d):
    """One report row per record; a record has few uses, so the list is short."""
    t = records(spark, d)
    now = cut(rules.findings(t, *profile(spark), grounders(spark, d)))
    text = F.concat("use", F.lit("="), "status", F.lit("("), "reason_codes", F.lit(")"))
    said = R.decide(now, t["uses"].distinct()).groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("decisions"))
    n = now.groupBy("record_id").agg(F.sum("n").alias("n_findings"), F.bool_or(F.col("rule_id") == "SCHEMA").alias("bad"))
    return said.join(n, "record_id", "left").select("record_id", "decisions", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), (~F.coalesce("bad", F.lit(False))).alias("schema_valid"))


QUERIES, ORACLES = query.queries, query.oracles
