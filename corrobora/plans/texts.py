"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import table
from .registry import Registry

query = Registry()
_ITEMS = "(SELECT DISTINCT id, record_id, source_artifact_id, locator, extracted_text, evidence_type, extraction_method FROM evidence_items)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_items").select("id", "record_id", "source_artifact_id", "locator", "extracted_text", "evidence_type", "extraction_method").distinct()


@query("op_F1")
def canonical(spark, d):
    return table(spark, d, "episodes").select("episode_id", F.sha2(T.canonical_json("payload"), 256).alias("canonical_sha256")).distinct()


@query("op_F2", f"SELECT id, sha256(extracted_text) AS h64, left(sha256(extracted_text), 16) AS h16, upper(left(sha256(extracted_text), 6)) AS h6 FROM {_ITEMS} WHERE extracted_text IS NOT NULL")
def digests(spark, d):
    t = F.col("extracted_text")
    return items(spark, d).where(t.isNotNull()).select("id", T.digest(t).alias("h64"), T.digest(t, 16).alias("h16"), F.upper(T.digest(t, 6)).alias("h6"))


@query("op_F3", f"""WITH p AS (SELECT id, string_split(locator, ';') AS ps FROM {_ITEMS} WHERE locator IS NOT NULL),
g AS (SELECT id, ps FROM p WHERE len(list_filter(ps, lambda x: instr(x, '=') = 0 OR trim(split_part(x, '=', 1)) = '')) = 0),
u AS (SELECT id, unnest(ps) AS x, generate_subscripts(ps, 1) AS n FROM g),
k AS (SELECT id, trim(split_part(x, '=', 1)) AS key, trim(substr(x, instr(x, '=') + 1)) AS value, n FROM u)
SELECT id, key, arg_max(value, n) AS value FROM k GROUP BY id, key""")
def locator_pairs(spark, d):
    return items(spark, d).where("locator is not null").select("id", F.inline(T.pairs(F.col("locator"))))


@query("op_F4", "SELECT DISTINCT work_key, CASE WHEN instr(work_key, ':') > 0 THEN split_part(work_key, ':', 1) ELSE '' END AS prefix FROM works")
def prefixes(spark, d):
    return table(spark, d, "works").select("work_key", T.curie_prefix(F.col("work_key")).alias("prefix")).distinct()


@query("op_F5", """SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> ''),
lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END), ' ') AS label_key FROM ref_terms""")
def label_keys(spark, d):
    return table(spark, d, "ref_terms").select("id", T.label_key(F.col("name")).alias("label_key"))


@query("op_F6")
def normalized(spark, d):
    return items(spark, d).where("extracted_text is not null").select("id", F.md5(T.normalized("extracted_text")).alias("normalized_md5"))


@query("op_F10", """WITH u AS (SELECT DISTINCT work_key AS uri FROM works UNION SELECT ' PMID: 00' || substr(work_key, 6) FROM works UNION SELECT 'https://doi.org/10.5555/' || upper(resolver) FROM works UNION SELECT 'http://example.org/' || resolver FROM works)
SELECT uri, CASE WHEN lower(trim(uri)) LIKE 'pmid:%' AND regexp_matches(trim(substr(trim(uri), 6)), '^[0-9]+$') THEN 'pmid:' || ltrim(trim(substr(trim(uri), 6)), '0') WHEN uri LIKE 'https://doi.org/10.%' THEN 'doi:' || lower(substr(uri, 17)) WHEN uri LIKE 'doi:10.%' THEN lower(uri) END AS key FROM u""")
def identifiers(spark, d):
    w = table(spark, d, "works").select("work_key", "resolver")
    forms = F.array("work_key", F.concat(F.lit(" PMID: 00"), F.substring("work_key", 6, 100)), F.concat(F.lit("https://doi.org/10.5555/"), F.upper("resolver")), F.concat(F.lit("http://example.org/"), "resolver"))
    return w.select(F.explode(forms).alias("uri")).where("uri is not null").distinct().select("uri", T.identifier(F.col("uri")).alias("key"))


@query("op_F11", "SELECT DISTINCT work_key, regexp_replace(work_key, '[^0-9]', '', 'g') AS pmid FROM works")
def pmids(spark, d):
    return table(spark, d, "works").select("work_key", T.digits(F.col("work_key")).alias("pmid")).distinct()


@query("op_F12", f"""WITH c AS (SELECT id, regexp_extract(locator, 'pct_in\\s*=\\s*"?([0-9.]+)', 1) AS claimed FROM {_ITEMS} WHERE locator LIKE '%pct_in%')
SELECT id, abs(CAST(claimed AS DOUBLE) - 0.5) <= 0.5 * power(10.0, -CASE WHEN instr(claimed, '.') > 0 THEN length(split_part(claimed, '.', 2)) ELSE 0 END) + 1e-12 AS same FROM c WHERE claimed <> ''""")
def same_values(spark, d):
    claimed = F.regexp_extract("locator", r'pct_in\s*=\s*"?([0-9.]+)', 1)
    return items(spark, d).where("locator like '%pct_in%'").select("id", claimed.alias("claimed")).where("claimed <> ''").select("id", T.same_value(F.col("claimed"), F.lit("0.5")).alias("same"))


@query("op_F13", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_words FROM documents WHERE text IS NOT NULL")
def word_sets(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.word_set(F.col("text"))).alias("n_words"))


@query("op_F14")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))


def cue_sql(pattern: str, text: str = "extracted_text") -> str:
    """has_cue in SQL: whole words by the letters and digits of Unicode around them."""
    words = pattern.removeprefix(r"(?i)\b").removesuffix(r"\b").replace(r"\w", r"[\pL\pN_]").replace("'", "''")
    return f"regexp_matches({text}, '(?i)(?:^|[^\\pL\\pN_]){words}(?:[^\\pL\\pN_]|$)')"


@query("op_F15", f"""SELECT evidence_type, count(*) AS n, count_if({cue_sql(T.NEGATION)}) AS negated, count_if({cue_sql(T.HEDGE)}) AS hedged, count_if({cue_sql(T.NON_HUMAN)} AND NOT {cue_sql(T.HUMAN)}) AS not_human
FROM {_ITEMS} WHERE extracted_text <> '' GROUP BY evidence_type""")
def cues(spark, d):
    """Cues in all texts that aren't empty."""
    t = F.col("extracted_text")
    return items(spark, d).where(t != "").groupBy("evidence_type").agg(F.count("*").alias("n"), F.count_if(T.has_cue(t, T.NEGATION)).alias("negated"), F.count_if(T.has_cue(t, T.HEDGE)).alias("hedged"), F.count_if(T.has_cue(t, T.NON_HUMAN) & ~T.has_cue(t, T.HUMAN)).alias("not_human"))


@query("op_F16", f"""WITH c AS (SELECT DISTINCT 'NC_000007.14:' || regexp_extract(locator, '(g\\.[0-9]+[A-Z]>[A-Z])', 1) AS hgvs FROM {_ITEMS} WHERE regexp_matches(locator, 'g\\.[0-9]+[A-Z]>[A-Z]'))
SELECT hgvs, 'NC_000007' AS accession, '14' AS version, 'g' AS kind, split_part(hgvs, 'g.', 2) AS rest FROM c""")
def hgvs(spark, d):
    made = F.concat(F.lit("NC_000007.14:"), F.regexp_extract("locator", r"(g\.[0-9]+[A-Z]>[A-Z])", 1))
    part = lambda k: F.regexp_extract("hgvs", T.HGVS, k)
    return items(spark, d).where(F.col("locator").rlike(r"g\.[0-9]+[A-Z]>[A-Z]")).select(made.alias("hgvs")).distinct().select("hgvs", part(1).alias("accession"), part(2).alias("version"), part(3).alias("kind"), part(4).alias("rest"))


_SUBMITTED = "(SELECT DISTINCT task_id, unnest(source) AS s, generate_subscripts(source, 1) AS n FROM llm_tasks)"


_FORMS = (("^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "%b %d, %Y"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "%Y-%m-%d"), ("^[A-Za-z]{4,} [0-9]{1,2}, [0-9]{4}$", "%B %d, %Y"), ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "%d %b %Y"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "%Y/%m/%d"))
_DAY = ", ".join(f"CASE WHEN regexp_matches(v, '{form}') THEN strftime(try_strptime(v, '{how}'), '%b %d, %Y') END" for form, how in _FORMS)


@query("op_F17", rf"""WITH t AS (SELECT task_id, n, trim(regexp_replace(s.date_last_evaluated, '[\t-\r\x1c-\x1f\x{{85}}\pZ]+', ' ', 'g')) AS v FROM {_SUBMITTED})
SELECT task_id, CAST(n - 1 AS INTEGER) AS pos, CASE WHEN lower(v) IN ('', '-', 'none', 'n/a', 'not provided', 'unknown') THEN '-' ELSE coalesce({_DAY}, v) END AS written FROM t WHERE v IS NOT NULL""")
def classic_dates(spark, d):
    """All dates given, in the classic form 'Sep 08, 2016'; what names no date in a known form stays as it is."""
    rows = table(spark, d, "llm_tasks").select("task_id", "source").distinct().select("task_id", F.posexplode("source.date_last_evaluated").alias("pos", "v")).withColumn("v", T.clean(F.col("v")))
    return rows.where("v is not null").select("task_id", "pos", classic_date(F.col("v")).alias("written"))


def classic_date(v):
    forms = ((r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\p{L}{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))
    day = F.coalesce(*[F.when(v.rlike(form) & ~v.rlike(r"\b0000\b"), F.try_to_date(v, pattern)) for form, pattern in forms])
    return F.when(F.lower(v).isin("", "-", "none", "n/a", "not provided", "unknown"), "-").otherwise(F.coalesce(F.date_format(day, "MMM dd, yyyy"), v))


@query("op_F18", r"""SELECT DISTINCT annotation_id, regexp_matches(annotated_at, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$') AND TRY_CAST(left(annotated_at, 10) AS DATE) IS NOT NULL AND TRY_CAST(substr(annotated_at, 12, 2) AS INTEGER) < 24 AND TRY_CAST(substr(annotated_at, 15, 2) AS INTEGER) < 60 AS iso FROM annotations WHERE annotated_at IS NOT NULL""")
def iso_moments(spark, d):
    return table(spark, d, "annotations").where("annotated_at is not null").select("annotation_id", T.iso_moment(F.col("annotated_at")).alias("iso")).distinct()


@query("op_F19", """SELECT DISTINCT annotation_id, json_valid(evidence_refs_json) AND coalesce(json_type(CASE WHEN json_valid(evidence_refs_json) THEN evidence_refs_json END) = 'ARRAY', false) AS fine FROM annotations WHERE evidence_refs_json IS NOT NULL""")
def json_lists(spark, d):
    return table(spark, d, "annotations").where("evidence_refs_json is not null").select("annotation_id", T.json_text_list(F.col("evidence_refs_json")).alias("fine")).distinct()


@query("op_F20", r"SELECT DISTINCT case_id, trim(regexp_replace(query_text, '[\t-\r\x1c-\x1f\x{85}\pZ]+', ' ', 'g')) AS cleaned FROM name_queries WHERE query_text IS NOT NULL")
def cleaned(spark, d):
    """All texts asked for, in single blanks."""
    return table(spark, d, "name_queries").where("query_text is not null").select("case_id", T.clean(F.col("query_text")).alias("cleaned")).distinct()


@query("op_F21", "SELECT DISTINCT annotation_id, regexp_replace(lower(trim(admission_label)), '[\\s-]+', '_', 'g') AS choice FROM annotations")
def choices(spark, d):
    return table(spark, d, "annotations").select("annotation_id", T.choice(F.col("admission_label")).alias("choice")).distinct()


@query("op_F22", f"SELECT id, trim(trim(locator, '#[]')) AS paragraph FROM {_ITEMS} WHERE locator LIKE '#%'")
def paragraph_ids(spark, d):
    return items(spark, d).where("locator like '#%'").select("id", T.paragraph_id(F.col("locator")).alias("paragraph"))


@query("op_F23", f"SELECT id, CASE WHEN instr(locator, '#') > 0 THEN list_last(string_split(locator, '#')) ELSE '' END AS anchor FROM {_ITEMS} WHERE locator IS NOT NULL")
def anchors(spark, d):
    return items(spark, d).where("locator is not null").select("id", T.anchor(F.col("locator")).alias("anchor"))


@query("op_F24")
def title_keys(spark, d):
    return table(spark, d, "ref_terms").select("id", T.title_key("name").alias("title_key"))


@query("op_F25", """SELECT DISTINCT work_key, CASE WHEN regexp_matches(lower(coalesce(license, '')), 'cc0|publicdomain/zero') THEN 'cc0' WHEN regexp_matches(lower(license), 'cc by|creativecommons\\.org/licenses/by/|creative commons attribution') AND NOT regexp_matches(lower(license), 'by-nc|by-nd|by-sa|noncommercial|non-commercial|noderiv|sharealike') THEN 'cc by' ELSE 'other' END AS licence FROM works""")
def licences(spark, d):
    return table(spark, d, "works").select("work_key", T.licence_class(F.col("license")).alias("licence")).distinct()


@query("op_F26", f"""SELECT task_id, CAST(n - 1 AS INTEGER) AS pos, CASE WHEN lower(s.classification) LIKE '%pathogenic%' AND lower(s.classification) NOT LIKE '%conflicting%' THEN 'supports' WHEN lower(s.classification) LIKE '%benign%' THEN 'contradicts' ELSE 'neutral' END AS direction FROM {_SUBMITTED}""")
def directions(spark, d):
    c = F.lower("classification")
    rows = table(spark, d, "llm_tasks").select("task_id", "source").distinct().select("task_id", F.posexplode("source.classification").alias("pos", "classification"))
    return rows.select("task_id", "pos", F.when(c.contains("pathogenic") & ~c.contains("conflicting"), "supports").when(c.contains("benign"), "contradicts").otherwise("neutral").alias("direction"))


@query("op_F27", f"""WITH t AS (SELECT DISTINCT id, unnest(string_split_regex(extracted_text, '[^A-Za-z0-9]+')) AS token FROM {_ITEMS} WHERE extracted_text IS NOT NULL)
SELECT t.id, t.token FROM t SEMI JOIN (SELECT symbol FROM genes WHERE status = 'Approved') g ON t.token = g.symbol""")
def gene_tokens(spark, d):
    tokens = items(spark, d).select("id", F.explode(F.array_distinct(F.split("extracted_text", "[^A-Za-z0-9]+"))).alias("token"))
    return tokens.join(table(spark, d, "genes").where("status = 'Approved'").select(F.col("symbol").alias("token")), "token", "left_semi").select("id", "token").distinct()


@query("op_F28", "SELECT id, array_to_string(list_concat(list_slice(w, 1, CAST(floor(len(w) / 2) AS BIGINT)), list_slice(w, CAST(floor(len(w) / 2) AS BIGINT) + 2, len(w))), ' ') AS edited FROM (SELECT id, string_split(name, ' ') AS w FROM ref_terms)")
def edited(spark, d):
    return table(spark, d, "ref_terms").select("id", T.without_middle_word(F.col("name")).alias("edited"))


@query("op_F31", "SELECT split, CASE WHEN count(*) > 0 THEN count_if(len(source) > 0) || '/' || count(*) ELSE 'N/A' END AS fraction FROM (SELECT DISTINCT task_id, split, source FROM llm_tasks) GROUP BY split")
def fractions(spark, d):
    return table(spark, d, "llm_tasks").select("task_id", "split", "source").distinct().groupBy("split").agg(T.percent(F.count_if(F.size("source") > 0), F.count("*")).alias("fraction"))


@query("op_F32", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM documents)
SELECT doc_id, CAST(min(n) AS INTEGER) AS first_with FROM p WHERE contains(para, 'odds ratio') GROUP BY doc_id""")
def context(spark, d):
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("n", "para"))
    return paras.where(T.quote_in(F.lit("odds ratio"), F.col("para"))).groupBy("doc_id").agg((F.min("n") + 1).alias("first_with"))


@query("op_U7", """WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(synonyms[1]), '[a-z0-9]+')) AS b FROM ref_terms WHERE len(synonyms) > 0)
SELECT id, 2 * len(list_intersect(a, b)) >= len(list_distinct(list_concat(a, b))) AS similar FROM w""")
def similar_titles(spark, d):
    a, b = T.word_set(F.col("name")), T.word_set(F.col("synonyms")[0])
    return table(spark, d, "ref_terms").where(F.size("synonyms") > 0).select("id", (T.jaccard(a, b) >= T.TITLE_OVERLAP).alias("similar"))


QUERIES, ORACLES = query.queries, query.oracles
