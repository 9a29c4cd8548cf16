"""Queries over readers and sinks, fed with text made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.packed import symbol_values
from ..sources import readers, sinks
from ..tables import table
from .registry import Registry
from .statistics import SYMBOLS

query = Registry()


@query("op_S1", "SELECT DISTINCT episode_id, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'invalid' END AS problem FROM episodes")
def strict(spark, d):
    return readers.strict_json(table(spark, d, "episodes").select("episode_id", "payload"), "payload").select("episode_id", "problem").distinct()


@query("op_S6", "SELECT DISTINCT id, sha256(extracted_text) AS digest, true AS verified FROM evidence_items WHERE extracted_text IS NOT NULL")
def verified(spark, d):
    e = table(spark, d, "evidence_items").where("extracted_text is not null").select("id", F.sha2("extracted_text", 256).alias("digest"), F.encode("extracted_text", "utf-8").alias("content")).distinct()
    return e.select("id", "digest", (F.sha2("content", 256) == F.col("digest")).alias("verified"))


@query("op_S7", "SELECT hgnc_id, v.k AS \"column\", v.x AS value FROM genes CROSS JOIN LATERAL (VALUES ('hgnc_id', hgnc_id), ('symbol', symbol), ('status', status)) AS v(k, x)")
def delimited(spark, d):
    made = table(spark, d, "genes").select("hgnc_id", F.concat(F.lit("hgnc_id\tsymbol\tstatus\n"), F.concat_ws("\t", "hgnc_id", "symbol", "status")).alias("content"))
    return readers.parse_delimited(made, "content").select("hgnc_id", "column", "value")


@query("op_S8", "SELECT id, name, coalesce(array_to_string(synonyms, '|'), '') AS synonyms, coalesce(obsolete, false) AS obsolete, coalesce(array_to_string(replaced_by, '|'), '') AS replaced_by FROM ref_terms")
def obo(spark, d):
    """Reference terms written as OBO stanzas and read again."""
    t = readers.parse_obo(readers.obo_text(table(spark, d, "ref_terms").withColumn("parents", F.array().cast("array<string>"))))
    return t.select("id", "name", F.array_join("synonyms", "|").alias("synonyms"), "obsolete", F.array_join("replaced_by", "|").alias("replaced_by"))


@query("op_S10", f"SELECT hgnc_id, unnest({SYMBOLS.format('prev_symbol')}) AS old FROM genes")
def renamed(spark, d):
    return table(spark, d, "genes").select("hgnc_id", F.explode(symbol_values(F.col("prev_symbol"))).alias("old"))


@query("op_S11", "SELECT symbol AS accession, hgnc_id AS name, CAST(length(name) AS BIGINT) AS length FROM genes WHERE status = 'Approved'")
def assembly(spark, d):
    """Report lines made of genes: withdrawn ones have no accession."""
    g = table(spark, d, "genes")
    line = F.concat_ws("\t", "hgnc_id", F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"), F.when(F.col("status") == "Approved", F.col("symbol")).otherwise("na"), F.lit("f"), F.length("name").cast("string"))
    return readers.parse_assembly(g.select(line.alias("value")))


@query("op_S12")
def article(spark, d):
    xml = F.concat(F.lit("<article><body><sec><title>Of</title><p id='p1'>"), F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} .,]", " "), "[^ -~]", " "), F.lit("</p></sec></body></article>"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(readers.article_blocks(xml)).alias("b"))
    return docs.select("doc_id", "b.id", "b.kind", F.length("b.text").alias("n"))


@query("op_S14", "SELECT DISTINCT work_key, true AS found, 'Title ' || work_key AS title, license IS NULL AS retracted FROM works")
def resolver(spark, d):
    """Answers made for all works in the shape of their resolver."""
    w = table(spark, d, "works").select("work_key", "resolver", F.col("license").isNull().alias("r")).distinct()
    title, kind = F.concat(F.lit('"Title '), "work_key", F.lit('"')), F.when(F.col("r"), '"Retracted Publication"').otherwise('"journal article"')
    epmc = F.concat(F.lit('{"resultList":{"result":[{"title":'), title, F.lit(',"isOpenAccess":"Y","pubTypeList":{"pubType":['), kind, F.lit("]}}]}}"))
    ncbi = F.concat(F.lit('{"result":{"uids":["1"],"1":{"uid":"1","title":'), title, F.lit(',"pubtype":['), kind, F.lit("]}}}"))
    crossref = F.concat(F.lit('{"message":{"DOI":"10.5555/1","title":['), title, F.lit('],"updated-by":['), F.when(F.col("r"), '{"type":"retraction"}').otherwise(""), F.lit("]}}"))
    body = F.when(F.col("resolver").contains("europepmc"), epmc).when(F.col("resolver").rlike("ncbi|pubmed"), ncbi).otherwise(crossref)
    return readers.resolver_facts(w.select("work_key", "resolver", body.alias("body")), "resolver", "body").select("work_key", "found", "title", "retracted")


@query("op_S15", "SELECT DISTINCT work_key, unnest(urls) AS url FROM works")
def catalog(spark, d):
    return table(spark, d, "works").select("work_key", F.explode("urls").alias("url")).distinct()


@query("op_S18", "SELECT case_id, requested_use, reviewer_id, count(*) AS n FROM (SELECT DISTINCT annotation_id, case_id, requested_use, reviewer_id FROM annotations) GROUP BY ALL HAVING count(*) > 1")
def unique_predictions(spark, d):
    a = table(spark, d, "annotations").select("annotation_id", "case_id", "requested_use", "reviewer_id").distinct()
    return a.groupBy("case_id", "requested_use", "reviewer_id").agg(F.count("*").alias("n")).where("n > 1")


@query("op_S20", "SELECT DISTINCT episode_id, json_extract_string(payload, '$.model') AS model FROM episodes WHERE json_valid(payload) AND json_extract_string(payload, '$.model') IS NOT NULL")
def json_lines(spark, d):
    good = table(spark, d, "episodes").select("episode_id", F.try_parse_json("payload").alias("v"))
    return good.select("episode_id", F.try_variant_get("v", "$.model", "string").alias("model")).where("model is not null").distinct()


@query("op_S26", "SELECT DISTINCT sha256(extracted_text) AS sha256 FROM evidence_items WHERE extracted_text IS NOT NULL")
def content_addressed(spark, d):
    return sinks.by_content(table(spark, d, "evidence_items").where("extracted_text is not null"), "extracted_text").select("sha256")


@query("op_S28", "SELECT extraction_method AS status, count(DISTINCT record_id) AS n_files FROM evidence_items GROUP BY 1")
def rollup(spark, d):
    return sinks.status_rollup(table(spark, d, "evidence_items").withColumnRenamed("extraction_method", "status"), "record_id", "status")


QUERIES, ORACLES = query.queries, query.oracles
