"""Case pipelines, recorded loops, text matchers of the scorers, and round trips through readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grounding as G
from ..operators import hierarchy
from ..sources import readers, sinks
from ..tables import cut, shared_dir, table
from .prepare import _EDGES
from .registry import Registry
from .statistics import labels
from .texts import _ITEMS, cue_sql, items

query = Registry()


# Text


@query("op_F7")
def plain_texts(spark, d):
    return items(spark, d).where("extracted_text is not null").select("id", F.md5(T.plain(F.col("extracted_text"))).alias("plain_md5"))


_STEM = "rtrim(quote, ' .;:')"


@query("op_F8", f"""WITH q AS (SELECT id, extracted_text AS t, regexp_replace(extracted_text, ' *[(][^()]*[)][.]?$', '.') AS quote FROM {_ITEMS} WHERE extracted_text IS NOT NULL)
SELECT id, contains(t, quote) OR {_STEM} <> '' AND contains(t, {_STEM}) AND regexp_matches(t, regexp_escape({_STEM}) || '\\s*(?:\\([^()]*\\)\\s*)*(?:[.;:]|$)') AS found FROM q""")
def quotes_in(spark, d):
    """Is a text's quote without its last bracketed reference in the text?"""
    t = F.col("extracted_text")
    q = items(spark, d).where(t.isNotNull()).select("id", "extracted_text", F.regexp_replace(t, " *[(][^()]*[)][.]?$", ".").alias("quote"))
    return q.select("id", T.quote_in(F.col("quote"), t).alias("found"))


@query("op_F9")
def in_papers(spark, d):
    """As the scorer asks: in one paragraph, both in plain form, whatever brackets stand before the last mark."""
    t = F.col("extracted_text")
    q = items(spark, d).where(t.isNotNull()).select("id", F.split(t, "\n\n").alias("paragraphs"), F.regexp_replace(t, " *[(][^()]*[)][.]?$", ".").alias("quote"))
    return q.select("id", "quote", F.explode("paragraphs").alias("p")).groupBy("id").agg(F.bool_or(T.in_paper(F.col("quote"), F.col("p"))).alias("found"))


# Ontology and publication readers


@query("op_S9", _EDGES + """, top AS (SELECT min(id) AS id FROM n WHERE id NOT IN (SELECT child FROM e))
SELECT DISTINCT t.id, t.name, coalesce(array_to_string(t.synonyms, '|'), '') AS synonyms FROM terms t JOIN a ON a.node = t.id JOIN top ON top.id = a.origin WHERE NOT coalesce(t.obsolete, false)""")
def subtree(spark, d):
    """Terms under one root that aren't obsolete, with their synonyms, by a walk down from the root."""
    t = table(spark, d, "terms")
    nodes, edges = hierarchy.term_edges(t)
    edges = cut(edges)
    top = nodes.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_anti").agg(F.min("id").alias("node")).where("node is not null")
    inside = hierarchy.under(top, edges).select(F.col("node").alias("id"))
    return t.where("not coalesce(obsolete, false)").join(inside, "id", "left_semi").select("id", "name", F.coalesce(F.array_join("synonyms", "|"), F.lit("")).alias("synonyms")).distinct()


_XML = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g')"


def _clean(text):
    return "trim(regexp_replace(" + text + r", '[\t-\r\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))"




@query("op_S13", f"SELECT doc_id, 'title' AS kind, 't' AS id, md5({_clean('source')}) AS text_md5 FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'p', 'a1', md5({_clean(_XML)}) FROM documents WHERE text IS NOT NULL")
def abstracts(spark, d):
    """Titles and numbered abstract sections of publication records made of the documents."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation><Article><ArticleTitle>"), safe(F.coalesce("source", F.lit(""))), F.lit("</ArticleTitle><Abstract><AbstractText>"), safe(F.col("text")), F.lit("</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(readers.abstract_blocks(xml)).alias("b")).select("doc_id", "b.kind", "b.id", F.md5("b.text").alias("text_md5"))


# Names against an ontology: build, and compare with a rebuilt record


_NAMED = f"""WITH l AS (SELECT DISTINCT id, {_clean('lower(name)')} AS k FROM ref_terms UNION SELECT id, {_clean('lower(s)')} FROM (SELECT id, unnest(synonyms) AS s FROM ref_terms)), q AS (SELECT DISTINCT case_id, query_text, {_clean('lower(query_text)')} AS k FROM name_queries WHERE entity_type = 'cell_type' AND query_text IS NOT NULL),
b AS (SELECT q.case_id, q.query_text, array_to_string(list_sort(list(DISTINCT l.id)), '|') AS candidates, min(l.id) AS target, CASE WHEN count(DISTINCT l.id) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution FROM q JOIN l USING (k) GROUP BY q.case_id, q.query_text)"""


def name_records(spark, d):
    """(case_id, query_text, candidates, target, resolution) of names that are a term's name or synonym but for case and blanks."""
    t = table(spark, d, "ref_terms")
    key = lambda c: T.clean(F.lower(c))
    known = t.select("id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("label")).where("label is not null").select("id", key("label").alias("k")).distinct()
    q = table(spark, d, "name_queries").where("entity_type = 'cell_type' and query_text is not null").select("case_id", "query_text", key("query_text").alias("k")).distinct()
    ids = F.array_sort(F.collect_set("id"))
    return q.join(known, "k").groupBy("case_id", "query_text").agg(F.array_join(ids, "|").alias("candidates"), F.min("id").alias("target"), F.when(F.size(ids) == 1, "unique").otherwise("ambiguous").alias("resolution"))


query("op_R7", _NAMED + " SELECT * FROM b")(name_records)


@query("op_P26", _NAMED + """, c AS (SELECT *, substr(sha256('n' || case_id), 1, 1) AS h FROM b), r AS (SELECT *, CASE h WHEN '0' THEN 'XX:0' WHEN '1' THEN (SELECT max(id) FROM ref_terms) ELSE target END AS said, CASE h WHEN '2' THEN 'ambiguous' ELSE resolution END AS told, CASE h WHEN '3' THEN 'other' END AS label FROM c)
SELECT case_id, query_text, CASE WHEN t.id IS NULL THEN 'BEV016' WHEN NOT list_contains(string_split(candidates, '|'), said) THEN 'BEV017' WHEN label IS NOT NULL AND label <> t.name THEN 'BEV017' END AS target_code, CASE WHEN told <> resolution THEN 'BEV017' END AS resolution_code FROM r LEFT JOIN ref_terms t ON t.id = said""")
def rebuilt_names(spark, d):
    """Records with drawn faults (unknown term, other term, other label, other resolution) against those built anew."""
    t = table(spark, d, "ref_terms")
    h = F.substring(F.sha2(F.concat(F.lit("n"), F.col("case_id").cast("string")), 256), 1, 1)
    last = t.agg(F.max("id").alias("last"))
    r = name_records(spark, d).withColumn("h", h).join(F.broadcast(last)).select("*", F.when(F.col("h") == "0", "XX:0").when(F.col("h") == "1", F.col("last")).otherwise(F.col("target")).alias("said"), F.when(F.col("h") == "2", "ambiguous").otherwise(F.col("resolution")).alias("told"), F.when(F.col("h") == "3", "other").alias("label"))
    j = r.join(t.select(F.col("id").alias("_id"), F.col("name").alias("_name")), F.col("said") == F.col("_id"), "left")
    target = G.cascade((F.col("_id").isNull(), "BEV016"), (~F.array_contains(F.split("candidates", r"\|"), F.col("said")), "BEV017"), (F.col("label") != F.col("_name"), "BEV017"))
    return j.select("case_id", "query_text", target.alias("target_code"), F.when(F.col("told") != F.col("resolution"), "BEV017").alias("resolution_code"))


# A library of archived sources: citation, source, publication, quote, admission


_LIBRARY = f"""WITH src AS (SELECT work_key, max(metadata_sha256) AS sha, bool_or(license IS NULL) AS retracted FROM works WHERE metadata_sha256 IS NOT NULL GROUP BY 1), blk AS (SELECT work_key, coalesce(section, 'text') AS section, arg_min(text, doc_id) AS text FROM documents WHERE work_key IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
c AS (SELECT id, record_id, source_artifact_id AS work_key, coalesce(extracted_text, '') AS quote, CASE substr(sha256('k' || id), 1, 1) WHEN '0' THEN 'file:1' WHEN '1' THEN 'evidence:cv_' || sha256(source_artifact_id) || '#nowhere' ELSE 'evidence:cv_' || sha256(source_artifact_id) || '#abstract' END AS citation, substr(sha256('m' || id), 1, 1) = '0' AS altered, substr(sha256('t' || id), 1, 1) = '0' AS retitled, substr(sha256('v' || id), 1, 1) < '8' AS reviewed FROM {_ITEMS})"""


def library(spark, d):
    """(id, code): an ordered cascade over a citation's form, its block, its source's digest, the publication's standing,
    identity and title, the quote and its review; null where the quote is verified. Blocks are keyed by source and section."""
    sources = table(spark, d, "works").where("metadata_sha256 is not null").groupBy("work_key").agg(F.max("metadata_sha256").alias("sha"), F.bool_or(F.col("license").isNull()).alias("retracted")).withColumn("key", F.sha2("work_key", 256))
    blocks = table(spark, d, "documents").where("work_key is not null and text is not null").groupBy(F.sha2("work_key", 256).alias("key"), F.coalesce("section", F.lit("text")).alias("section")).agg(F.min_by("text", "doc_id").alias("text"))
    i = F.col("id")
    h = lambda salt: F.substring(F.sha2(F.concat(F.lit(salt), i), 256), 1, 1)
    cv = F.concat(F.lit("evidence:cv_"), F.sha2("source_artifact_id", 256))
    citation = F.when(h("k") == "0", "file:1").when(h("k") == "1", F.concat(cv, F.lit("#nowhere"))).otherwise(F.concat(cv, F.lit("#abstract")))
    c = items(spark, d).select("id", F.col("source_artifact_id").alias("own"), F.coalesce("extracted_text", F.lit("")).alias("quote"), citation.alias("citation"), (h("m") == "0").alias("altered"), (h("t") == "0").alias("retitled"), (h("v") < "8").alias("reviewed"))
    form = r"^evidence:cv_([0-9a-f]{64})#([A-Za-z0-9][A-Za-z0-9_.:-]{0,199})$"
    c = c.withColumns({"key": F.regexp_extract("citation", form, 1), "section": F.regexp_extract("citation", form, 2)})
    # a block meets its quotes once: only they travel to the text
    j = c.join(sources.drop("work_key"), "key", "left").join(blocks, ["key", "section"], "left")
    code = G.cascade(
        (F.col("key") == "", "BEV015"), (F.trim("quote") == "", "BEV015"), (F.col("text").isNull() | F.col("sha").isNull(), "BEV017"), (F.col("altered"), "BEV017"), (F.col("retracted"), "BEV019"),
        (T.identifier(F.col("own")).isNull(), "BEV015"), (F.col("retitled"), "BEV017"), (~F.contains("text", "quote"), "BEV017"), (~F.col("reviewed"), "BEV015"),
    )
    return j.select("id", code.alias("code"))


query("op_P24", _LIBRARY + """ SELECT id, CASE WHEN citation LIKE 'file:%' OR c.work_key IS NULL THEN 'BEV015' WHEN trim(quote) = '' THEN 'BEV015' WHEN blk.text IS NULL OR sha IS NULL THEN 'BEV017' WHEN altered THEN 'BEV017' WHEN retracted THEN 'BEV019' WHEN NOT regexp_matches(c.work_key, '^(pmid:[0-9]+|doi:10[.].+)$') THEN 'BEV015' WHEN retitled THEN 'BEV017' WHEN NOT contains(blk.text, quote) THEN 'BEV017' WHEN NOT reviewed THEN 'BEV015' END AS code
FROM c LEFT JOIN src ON src.work_key = c.work_key LEFT JOIN blk ON blk.work_key = c.work_key AND blk.section = split_part(c.citation, '#', 2)""")(library)


@query("op_S23", _LIBRARY + " SELECT src.work_key, sha, retracted, count(blk.section) AS blocks FROM src LEFT JOIN blk USING (work_key) GROUP BY ALL")
def stored(spark, d):
    """The library's sources with their standing and number of blocks."""
    src = table(spark, d, "works").where("metadata_sha256 is not null").groupBy("work_key").agg(F.max("metadata_sha256").alias("sha"), F.bool_or(F.col("license").isNull()).alias("retracted"))
    blk = table(spark, d, "documents").where("work_key is not null and text is not null").groupBy("work_key").agg(F.count_distinct(F.coalesce("section", F.lit("text"))).alias("blocks"))
    return src.join(blk, "work_key", "left").select("work_key", "sha", "retracted", F.coalesce("blocks", F.lit(0)).alias("blocks"))


# Records, review units, views of answers


@query("op_R8", f"SELECT id, source_artifact_id AS subject, CASE WHEN substr(sha256('d' || id), 1, 1) < '4' THEN 'does_not_support' ELSE 'supports' END AS predicate, coalesce(extracted_text, '') <> '' AS quoted, sha256(coalesce(extracted_text, '')) AS item FROM {_ITEMS} WHERE evidence_type = 'publication_quote'")
def quote_records(spark, d):
    e = items(spark, d).where("evidence_type = 'publication_quote'")
    t = F.coalesce("extracted_text", F.lit(""))
    return e.select("id", F.col("source_artifact_id").alias("subject"), F.when(F.substring(F.sha2(F.concat(F.lit("d"), "id"), 256), 1, 1) < "4", "does_not_support").otherwise("supports").alias("predicate"), (t != "").alias("quoted"), F.sha2(t, 256).alias("item"))


_U = f"(SELECT id, record_id, extracted_text AS t FROM {_ITEMS} WHERE extracted_text <> '' AND evidence_type = 'publication_quote')"


@query("op_R18", f"""WITH u AS {_U}, g AS (SELECT record_id, min(id) AS own FROM u GROUP BY 1), o AS (SELECT record_id, own, lead(own) OVER (ORDER BY record_id) AS donor FROM g)
SELECT id AS unit, 'natural' AS kind, CAST(NULL AS VARCHAR) AS donor FROM u
UNION ALL SELECT id, 'species', NULL FROM u WHERE {cue_sql(T.NON_HUMAN, 't')} AND NOT {cue_sql(T.HUMAN, 't')} UNION ALL SELECT id, 'hedged', NULL FROM u WHERE {cue_sql(T.HEDGE, 't')} UNION ALL SELECT own, 'unrelated', donor FROM o WHERE donor IS NOT NULL""")
def review_units(spark, d):
    """Units for review with their hidden kind: quotes as they are, those on other species, hedged ones, and claims
    beside the first quote of the next record."""
    from .ordering import places

    u = items(spark, d).where("extracted_text <> '' and evidence_type = 'publication_quote'").select("id", "record_id", F.col("extracted_text").alias("t"))
    t, none = F.col("t"), F.lit(None).cast("string").alias("donor")
    kinds = F.array(F.lit("natural"), F.when(T.has_cue(t, T.NON_HUMAN) & ~T.has_cue(t, T.HUMAN), "species"), F.when(T.has_cue(t, T.HEDGE), "hedged"))
    one = u.select(F.col("id").alias("unit"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), none)
    first = places(u.groupBy("record_id").agg(F.min("id").alias("own")).where("record_id is not null"), "record_id")
    after = first.select((F.col("place") - 1).alias("place"), F.col("own").alias("donor"))
    return one.unionByName(first.join(after, "place").select(F.col("own").alias("unit"), F.lit("unrelated").alias("kind"), "donor"))


@query("op_P34", "WITH t AS (SELECT task_id, any_value(source) AS s FROM llm_tasks GROUP BY 1), f AS (SELECT task_id, len(list_distinct(list_filter(list_transform(s, lambda x: x.classification), lambda x: x IS NOT NULL))) > 1 AS conflict, len(s) > 0 AS answered, len(s) > 0 AND len(list_filter(s, lambda x: x.scv IS NULL)) = 0 AS admitted FROM t WHERE s IS NOT NULL) SELECT task_id, v.view AS view, CASE v.view WHEN 'gated' THEN conflict OR NOT admitted ELSE answered AND conflict END AS flagged, CASE v.view WHEN 'gated' THEN admitted ELSE answered END AS delivered FROM f CROSS JOIN (VALUES ('gated'), ('alone')) AS v(view)")
def delivered(spark, d):
    """Two views of an answer: alone, it is delivered if there is one; gated, only if admitted, and what isn't is flagged."""
    t = table(spark, d, "llm_tasks").groupBy("task_id").agg(F.any_value("source").alias("s")).where("s is not null")
    conflict = F.size(F.array_distinct(F.filter("s.classification", lambda x: x.isNotNull()))) > 1
    f = t.select("task_id", conflict.alias("conflict"), (F.size("s") > 0).alias("answered"), ((F.size("s") > 0) & (F.size(F.filter("s.scv", lambda x: x.isNull())) == 0)).alias("admitted"))
    views = F.array(F.struct(F.lit("gated").alias("view"), (F.col("conflict") | ~F.col("admitted")).alias("flagged"), F.col("admitted").alias("delivered")), F.struct(F.lit("alone").alias("view"), (F.col("answered") & F.col("conflict")).alias("flagged"), F.col("answered").alias("delivered")))
    return f.select("task_id", F.inline(views))


# Recorded loops


_TRIES = "(SELECT DISTINCT episode_id, md5(payload) AS payload, a.value AS a, CAST(a.key AS INTEGER) AS n FROM episodes, json_each(CASE WHEN json_valid(payload) AND json_type(payload, '$.attempts') = 'ARRAY' THEN payload ELSE '{\"attempts\":[]}' END, '$.attempts') a)"


def tries(spark, d):
    """(episode_id, payload, n, status, to_expert): the attempts of recorded episodes."""
    v = table(spark, d, "episodes").select("episode_id", F.md5("payload").alias("payload"), F.try_variant_get(F.try_parse_json("payload"), "$.attempts", "array<variant>").alias("a")).where("a is not null")
    rows = v.select("episode_id", "payload", F.posexplode("a").alias("n", "a"))
    return rows.select("episode_id", "payload", "n", F.try_variant_get("a", "$.bioevidence.status", "string").alias("status"), F.coalesce(F.try_variant_get("a", "$.to_expert", "boolean"), F.lit(False)).alias("to_expert")).distinct()


ROUNDS = 3


@query("op_C1", f"WITH t AS (SELECT episode_id, payload, n, json_extract_string(a, '$.bioevidence.status') AS status, coalesce(TRY_CAST(json_extract_string(a, '$.to_expert') AS BOOLEAN), false) AS to_expert FROM {_TRIES}), s AS (SELECT episode_id, payload, min(CASE WHEN status = 'admitted' OR to_expert THEN n END) AS stop, max(n) AS last FROM t GROUP BY ALL) SELECT episode_id, payload, least(coalesce(stop, last), {ROUNDS - 1}, last) + 1 AS rounds, CASE WHEN stop < {ROUNDS} THEN 'stopped' WHEN last >= {ROUNDS - 1} THEN 'rounds' ELSE 'given up' END AS ending FROM s")
def loops(spark, d):
    """How each recorded loop ends: at the first attempt that is admitted or goes to a person, after the rounds, or because no more came."""
    done = F.min(F.when((F.col("status") == "admitted") | F.col("to_expert"), F.col("n")))
    s = tries(spark, d).groupBy("episode_id", "payload").agg(done.alias("stop"), F.max("n").alias("last"))
    return s.select("episode_id", "payload", (F.least(F.coalesce("stop", "last"), F.lit(ROUNDS - 1), "last") + 1).alias("rounds"), F.when(F.col("stop") < ROUNDS, "stopped").when(F.col("last") >= ROUNDS - 1, "rounds").otherwise("given up").alias("ending"))


@query("op_W3", f"WITH t AS (SELECT episode_id, payload, n, json_extract_string(a, '$.bioevidence.status') AS status FROM {_TRIES}) SELECT episode_id, payload, arg_min(coalesce(status, ''), n) AS gate, arg_max(coalesce(status, ''), n) AS loop FROM t GROUP BY ALL")
def gate_and_loop(spark, d):
    s = F.coalesce("status", F.lit(""))
    return tries(spark, d).groupBy("episode_id", "payload").agg(F.min_by(s, "n").alias("gate"), F.max_by(s, "n").alias("loop"))


@query("op_R15", f"WITH i AS (SELECT id, record_id, source_artifact_id AS base, row_number() OVER (PARTITION BY record_id, source_artifact_id ORDER BY id) AS k, substr(sha256('f' || record_id), 1, 1) = '0' AS taken FROM {_ITEMS} WHERE record_id IS NOT NULL AND source_artifact_id IS NOT NULL) SELECT id, CASE WHEN k = 1 THEN base WHEN taken THEN base || '-' || (k + 1) ELSE base || '-' || k END AS fresh FROM i")
def fresh_ids(spark, d):
    """Names for items of a record after their source: the name itself, else with the first number that is free; '-2' is
    taken in some records."""
    i = items(spark, d).where("record_id is not null and source_artifact_id is not null").select("id", "record_id", F.col("source_artifact_id").alias("base"))
    k = F.row_number().over(Window.partitionBy("record_id", "base").orderBy("id"))
    taken = F.when(F.substring(F.sha2(F.concat(F.lit("f"), "record_id"), 256), 1, 1) == "0", F.array(F.concat("base", F.lit("-2")))).otherwise(F.array().cast("array<string>"))
    return i.withColumns({"k": k, "taken": taken}).select("id", T.fresh(F.col("base"), F.col("k"), F.col("taken")).alias("fresh"))


@query("op_C2", f"""WITH i AS (SELECT *, substr(sha256('y' || id), 1, 1) < '8' AS before, substr(sha256('z' || id), 1, 1) < 'c' AS verified FROM {_ITEMS} WHERE record_id IS NOT NULL), k AS (SELECT record_id, source_artifact_id, coalesce(locator, '') AS l, coalesce(extracted_text, '') AS t, min(id) AS id FROM i WHERE before AND verified GROUP BY ALL), p AS (SELECT DISTINCT record_id, source_artifact_id, coalesce(locator, '') AS l, coalesce(extracted_text, '') AS t FROM i WHERE NOT before), n AS (SELECT DISTINCT record_id, id FROM i WHERE NOT before)
SELECT k.record_id, k.id AS carried, k.id || '-2' AS as_id FROM k ANTI JOIN p ON p.record_id = k.record_id AND p.source_artifact_id IS NOT DISTINCT FROM k.source_artifact_id AND p.l = k.l AND p.t = k.t WHERE k.record_id IN (SELECT record_id FROM n)""")
def carry(spark, d):
    """Verified evidence of the attempt before (half the items) that the next one of the same record left out, by source,
    locator and text, once each, under a fresh id: the next attempt is taken to use the old ids for other items."""
    h = lambda salt: F.substring(F.sha2(F.concat(F.lit(salt), "id"), 256), 1, 1)
    i = items(spark, d).where("record_id is not null").select("id", "record_id", F.coalesce("source_artifact_id", F.lit("")).alias("w"), F.coalesce("locator", F.lit("")).alias("l"), F.sha2(F.coalesce("extracted_text", F.lit("")), 256).alias("t"), (h("y") < "8").alias("before"), (h("z") < "c").alias("verified"))
    key = ["record_id", "w", "l", "t"]
    old = i.where("before and verified").groupBy(*key).agg(F.min("id").alias("id"))
    now = i.where("not before")
    left = old.join(now.select(*key), key, "left_anti").join(now.select("record_id").distinct(), "record_id", "left_semi")
    return left.select("record_id", F.col("id").alias("carried"), T.fresh(F.col("id"), F.lit(1), F.array("id")).alias("as_id"))


# Round trips


def _folder(spark):
    return f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}"


_LAB = "SELECT case_id, requested_use, reviewer_id, adm FROM (SELECT DISTINCT * FROM (SELECT case_id, requested_use, reviewer_id, max(regexp_replace(lower(trim(admission_label)), '[\\s-]+', '_', 'g')) AS adm FROM annotations WHERE regexp_replace(lower(trim(admission_label)), '[\\s-]+', '_', 'g') IN ('admitted', 'review_required', 'rejected') GROUP BY ALL))"


@query("op_S17", _LAB)
def csv_trip(spark, d):
    """Labels written as CSV and read again under an exact header."""
    to = _folder(spark)
    labels(spark, d).write.option("header", True).csv(to)
    return readers.read_exact_csv(spark, to, ("case_id", "requested_use", "reviewer_id", "adm"))


@query("op_S21", _LAB)
def gzip_trip(spark, d):
    """Labels written as gzipped JSON Lines and read again."""
    to = _folder(spark)
    labels(spark, d).write.option("compression", "gzip").json(to)
    return readers.read_json_lines(spark, to, "case_id string, requested_use string, reviewer_id string, adm string")[0]


@query("op_S24", _LAB)
def new_trip(spark, d):
    """Labels written to a place where nothing is, as JSON, and read again."""
    to = _folder(spark)
    sinks.write_new(labels(spark, d), to)
    return spark.read.schema("case_id string, requested_use string, reviewer_id string, adm string").json(to)


@query("op_C8", _LAB)
def checked_trip(spark, d):
    """Labels appended in two parts, each only after the whole was checked for doubled units."""
    to = _folder(spark)
    every = cut(labels(spark, d))
    doubled = lambda df: df.groupBy("case_id", "requested_use", "reviewer_id").agg(F.count("*").alias("n")).where("n > 1")
    half = F.pmod(F.xxhash64("case_id"), F.lit(2)) == 0
    sinks.append_checked(every.where(half), to, every.limit(0), doubled)
    sinks.append_checked(every.where(~half), to, cut(spark.read.parquet(to)), doubled)
    return spark.read.parquet(to)


@query("op_S25", "SELECT hgnc_id, symbol, name FROM genes")
def tab_trip(spark, d):
    to = _folder(spark)
    table(spark, d, "genes").select("hgnc_id", "symbol", "name").write.option("sep", "\t").option("header", True).csv(to)
    return spark.read.option("sep", "\t").option("header", True).schema("hgnc_id string, symbol string, name string").csv(to)


@query("op_S22", "SELECT hgnc_id, symbol, CAST(NULL AS VARCHAR) AS missing FROM genes")
def headed_trip(spark, d):
    """Lines under a header that starts with '#', in another order than asked."""
    head = spark.createDataFrame([("#symbol\thgnc_id\tname",)], "value string")
    lines = table(spark, d, "genes").select(F.concat_ws("\t", "symbol", "hgnc_id", "name").alias("value"))
    return readers.parse_headed(head.unionByName(lines), "value", ("hgnc_id", "symbol", "missing"))


@query("op_S27", "SELECT site_id || '.txt' AS file, sha256(site_name) AS sha256, CAST(octet_length(encode(site_name)) AS BIGINT) AS bytes FROM sites WHERE site_name IS NOT NULL")
def manifest_trip(spark, d):
    """One small file per site and the manifest of their digests."""
    to = _folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in table(spark, d, "sites").where("site_name is not null").select("site_id", "site_name").distinct().collect():  # 20 fixed rows
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{r.site_id}.txt"))
        out.write(bytearray(r.site_name.encode()))
        out.close()
    return sinks.output_manifest(spark, to)


@query("op_S29", "SELECT true AS same_rows, false AS same_after_change")
def compared(spark, d):
    """Tables are equal whatever the order of their rows, and not with one row more."""
    a = table(spark, d, "genes")
    b = a.repartition(7).orderBy(F.desc("hgnc_id"))
    one = sinks.value_hash(a)
    return spark.createDataFrame([(one == sinks.value_hash(b), one == sinks.value_hash(a.unionByName(a.limit(1))))], "same_rows boolean, same_after_change boolean")


_YAML = """
id: trip
version: "1"
description: a profile
predicates: [associated_with]
subject_types: [gene]
object_types: []
uses:
  research_summary: {required_evidence_types: [publication_quote]}
  clinical_report: {required_evidence_types: [publication_quote, table_row]}
  expert_panel: {required_evidence_types: []}
"""


@query("op_S2", "SELECT * FROM (VALUES ('predicates', 'associated_with'), ('subject_types', 'gene')) AS v(field, allowed)")
def profile_lists(spark, d):
    return readers.profile_tables(spark, readers.load_profile(_YAML))[0]


@query("op_S3", "SELECT * FROM (VALUES ('research_summary', 'publication_quote'), ('clinical_report', 'publication_quote'), ('clinical_report', 'table_row'), ('expert_panel', NULL)) AS v(use, required_type)")
def profile_uses(spark, d):
    return readers.profile_tables(spark, readers.load_profile(_YAML))[1]


QUERIES, ORACLES = query.queries, query.oracles
