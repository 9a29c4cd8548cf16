"""Readers. Text is read as text and parsed by expressions, so that malformed input stays a row one can look at."""

from __future__ import annotations

import gzip
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 100
TERM = "id string, name string, synonyms array<string>, parents array<string>, obsolete boolean, replaced_by array<string>, consider array<string>, disjoint array<string>, relations array<struct<rel: string, target: string>>, short_labels array<string>"


@F.pandas_udf(T.IntegerType())
def json_depth(text: pd.Series) -> pd.Series:
    """Nesting of brackets outside strings."""

    def one(t):
        depth = deepest = 0
        quoted = escaped = False
        for c in t or "":
            if quoted:
                quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
                deepest = max(deepest, depth)
            elif c in "]}":
                depth -= 1
        return deepest

    return text.map(one)


def strict_json(df: DataFrame, text: str) -> DataFrame:
    """Adds `value` (variant) and `problem`: null for good JSON, 'null', 'invalid' (also members given twice and NaN) or
    'deep'."""
    df = df.withColumn("value", F.try_parse_json(text))
    return df.withColumn("problem", F.when(F.col(text).isNull(), "null").when(F.col("value").isNull(), "invalid").when(json_depth(text) > MAX_DEPTH, "deep"))


def read_json_records(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(path, text, value, problem) of JSON records, one a line or one a file; .gz is read as it is."""
    rows = spark.read.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return strict_json(rows, "text")


def read_json_lines(spark: SparkSession, path: str, schema: str, trailer: str = "models") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON Lines, and the metadata lines (those with the member `trailer`) apart."""
    text = spark.read.text(path)
    is_trailer = F.get_json_object("value", f"$.{trailer}").isNotNull()
    return text.where(~is_trailer).select(F.from_json("value", schema).alias("r")).select("r.*"), text.where(is_trailer)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, content, verified) of files named by the digest of their content; .gz content is unpacked."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.lower(F.substring_index(name, ".", 1))

    @F.pandas_udf(T.BinaryType())
    def unpacked(content: pd.Series) -> pd.Series:
        return content.map(lambda b: gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b)

    rows = files.where(F.length(F.substring_index(name, ".", 1)) == 64).select(digest.alias("sha256"), F.when(name.endswith(".gz"), unpacked("content")).otherwise(F.col("content")).alias("content"))
    return rows.withColumn("verified", F.sha2("content", 256) == F.col("sha256"))


def parse_delimited(df: DataFrame, content: str) -> DataFrame:
    """(.., row, column, value) of delimited texts in long form: tabs where the first line has one, else commas; values
    trimmed, missing ones ''. Columns row, column and value of the input are left out. Quoted commas are kept (quotes double inside a value)."""
    lines = F.filter(F.split(F.col(content).cast("string"), r"\r?\n"), lambda x: x != "")
    tab = F.instr(F.get(lines, F.lit(0)), "\t") > 0
    cells = lambda x: F.when(tab, F.split(x, "\t", -1)).otherwise(F.split(x, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    unquoted = lambda v: F.replace(F.regexp_replace(F.trim(v), '^"|"$', ""), F.lit('""'), F.lit('"'))
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (content, "row", "column", "value")]).alias("_kept")
    rows = df.where(F.col(content).isNotNull()).select(kept, cells(F.get(lines, F.lit(0))).alias("_header"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("row", "_line"), tab.alias("_tab"))
    comma = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    split = rows.select("_kept", "row", "_header", F.when(F.col("_tab"), F.split("_line", "\t", -1)).otherwise(F.split("_line", comma, -1)).alias("_cells"))
    wide = split.select("_kept", "row", F.posexplode("_header").alias("_k", "_column"), "_cells")
    return wide.select("_kept.*", "row", unquoted(F.col("_column")).alias("column"), F.coalesce(unquoted(F.get("_cells", F.col("_k"))), F.lit("")).alias("value"))


def read_exact_csv(spark: SparkSession, path: str, required: Iterable[str], optional: Iterable[str] = ()) -> DataFrame:
    """CSV of text columns with exactly the required and perhaps some optional ones; a mark at the start is skipped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    required, optional = set(required), set(optional)
    if not required <= set(df.columns) <= required | optional or len(set(df.columns)) < len(df.columns):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(required)} with any of {sorted(optional)}")
    return df


def _values(lines: Column, tag: str) -> Column:
    mine = F.filter(lines, lambda x: x.startswith(tag + ": "))
    return F.transform(mine, lambda x: F.trim(F.substring_index(F.substring(x, len(tag) + 3, 100_000_000), " ! ", 1)))


def parse_obo(stanzas: DataFrame, text: str = "value") -> DataFrame:
    """Terms of OBO stanzas, one stanza a row (a file read with a blank line as separator)."""
    lines = F.transform(F.split(F.trim(text), r"\r?\n"), lambda x: F.trim(x))
    df = stanzas.select(lines.alias("l")).where(F.element_at("l", 1) == "[Term]")
    l = F.col("l")
    first = lambda tag, default: F.coalesce(F.try_element_at(_values(l, tag), F.lit(1)), F.lit(default))
    word = lambda v, k: F.try_element_at(F.split(v, r"\s+"), F.lit(k))
    quoted = lambda v: F.replace(F.regexp_extract(v, r'^"((?:[^"\\]|\\.)*)" \w+', 1), F.lit('\\"'), F.lit('"'))
    synonyms = F.filter(_values(l, "synonym"), lambda v: v.rlike(r'^"(?:[^"\\]|\\.)*" \w+'))
    related = F.filter(F.concat(_values(l, "relationship"), _values(l, "intersection_of")), lambda v: F.size(F.split(v, r"\s+")) == 2)
    return df.select(
        first("id", "").alias("id"), first("name", "").alias("name"),
        F.transform(F.filter(synonyms, lambda v: v.rlike(r'^"(?:[^"\\]|\\.)*" EXACT\b')), quoted).alias("synonyms"),
        F.transform(_values(l, "is_a"), lambda v: word(v, 1)).alias("parents"), (first("is_obsolete", "false") == "true").alias("obsolete"),
        _values(l, "replaced_by").alias("replaced_by"), _values(l, "consider").alias("consider"), _values(l, "disjoint_from").alias("disjoint"),
        F.array_distinct(F.transform(related, lambda v: F.struct(word(v, 1).alias("rel"), word(v, 2).alias("target")))).alias("relations"),
        F.transform(F.filter(synonyms, lambda v: v.contains("PRO-short-label") | v.contains("Gene-based")), quoted).alias("short_labels"),
    )


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of OBO files; the stanzas of a large file are split among tasks."""
    return parse_obo(spark.read.text(path, lineSep="\n\n"))


def obo_text(terms: DataFrame) -> DataFrame:
    """(value): terms written as OBO stanzas, the inverse of parse_obo."""
    some = lambda c, form: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(form), x))
    synonyms = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: F.concat(F.lit('synonym: "'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('" EXACT []')))
    lines = F.concat(F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("name: "), F.coalesce("name", F.lit("")))), synonyms, some(F.col("parents"), "is_a: "), F.when(F.col("obsolete"), F.array(F.lit("is_obsolete: true"))).otherwise(F.array().cast("array<string>")), some(F.col("replaced_by"), "replaced_by: "))
    return terms.select(F.array_join(lines, "\n").alias("value"))


def parse_assembly(lines: DataFrame, text: str = "value") -> DataFrame:
    """(accession, name, length) of assembly report lines: nine columns, an accession that isn't 'na'."""
    c = F.split(text, "\t", -1)
    return lines.where(~F.col(text).startswith("#") & (F.size(c) >= 9)).select(c[6].alias("accession"), c[0].alias("name"), F.coalesce(c[8].try_cast("long"), F.lit(0)).alias("length")).where("accession <> 'na'")


def parse_headed(lines: DataFrame, text: str, columns: Iterable[str]) -> DataFrame:
    """Columns of tab-separated lines under a header line that starts with '#'."""
    header = lines.where(F.col(text).startswith("#")).select(F.split(F.substring(text, 2, 100_000), "\t").alias("h")).first()
    at = {name.strip(): k for k, name in enumerate(header["h"])} if header else {}
    return lines.where(~F.col(text).startswith("#")).select(*[(F.get(F.split(text, "\t", -1), F.lit(at[c])) if c in at else F.lit(None).cast("string")).alias(c) for c in columns])


BLOCKS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(BLOCKS)
def article_blocks(xml: pd.Series) -> pd.Series:
    """Titles and paragraphs of an article's XML in order: id (or its place among all elements), kind 'p' or 'title',
    text with blanks joined. Broken XML gives null. External entities are never read."""

    def one(data):
        if data is None:
            return None
        out, n = [], -1
        try:
            for _, e in ET.iterparse(io.BytesIO(data if isinstance(data, bytes) else data.encode()), events=("start",)):
                pass
            root = ET.fromstring(data)
        except ET.ParseError:
            return None
        for n, e in enumerate(root.iter()):
            tag = str(e.tag).rpartition("}")[2]
            if tag in ("p", "title", "article-title"):
                out.append({"id": e.get("id") or f"n{n}", "kind": "p" if tag == "p" else "title", "text": " ".join("".join(e.itertext()).split())})
        return out

    return xml.map(one)


@F.pandas_udf(BLOCKS)
def abstract_blocks(xml: pd.Series) -> pd.Series:
    """Of a publication record's XML its title (id 't') and abstract sections (a1, a2 ..); broken XML gives null."""

    def one(data):
        try:
            root = None if data is None else ET.fromstring(data)
        except ET.ParseError:
            return None
        if root is None:
            return None
        told = lambda e: " ".join("".join(e.itertext()).split())
        titles = [{"id": "t", "kind": "title", "text": told(e)} for e in list(root.iter("ArticleTitle"))[:1]]
        return titles + [{"id": f"a{n}", "kind": "p", "text": told(e)} for n, e in enumerate(root.iter("AbstractText"), 1)]

    return xml.map(one)


def resolver_facts(df: DataFrame, resolver: str, body: str) -> DataFrame:
    """Adds found, title, retracted, open_access and doi as a resolver's JSON answer tells them, for three shapes."""
    v = F.try_parse_json(body)
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    df = df.withColumn("_v", v)
    uid = get("$.result.uids[0]")
    doc = F.from_json(F.get_json_object(body, "$.result"), "map<string,string>")[uid]
    ncbi, epmc = F.col(resolver).rlike("ncbi|pubmed"), F.col(resolver).contains("europepmc")
    types = F.lower(F.coalesce(F.to_json(get("$.resultList.result[0].pubTypeList.pubType", "variant")), F.lit("")))
    notes = F.lower(F.coalesce(F.to_json(get("$.resultList.result[0].commentCorrectionList.commentCorrection", "variant")), F.lit("")))
    updates = F.lower(F.concat_ws(" ", F.to_json(get("$.message['updated-by']", "variant")), F.to_json(get("$.message['update-to']", "variant"))))
    found = F.when(ncbi, doc.isNotNull() & F.get_json_object(doc, "$.error").isNull()).when(epmc, get("$.resultList.result[0].title").isNotNull() | get("$.resultList.result[0].pmid").isNotNull()).otherwise(get("$.message.DOI").isNotNull() | get("$.message.title[0]").isNotNull())
    retracted = F.when(ncbi, F.coalesce(F.get_json_object(doc, "$.pubtype").contains("Retracted Publication"), F.lit(False))).when(epmc, types.contains("retracted publication") | notes.contains('"retraction in')).otherwise(updates.contains('"type":"retraction"'))
    title = F.when(ncbi, F.get_json_object(doc, "$.title")).when(epmc, get("$.resultList.result[0].title")).otherwise(get("$.message.title[0]"))
    doi = F.when(epmc, get("$.resultList.result[0].doi")).when(~ncbi, get("$.message.DOI"))
    return df.withColumns({"found": F.coalesce(found, F.lit(False)), "title": title, "retracted": retracted, "open_access": F.when(epmc, get("$.resultList.result[0].isOpenAccess") == "Y"), "doi": doi}).drop("_v")


def load_profile(data: str) -> dict:
    """A profile of uses and their requirements from YAML or JSON; unknown, missing or doubled keys are errors."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        pairs = [(loader.construct_object(k), loader.construct_object(v, deep=True)) for k, v in node.value]
        if len({k for k, _ in pairs}) < len(pairs) or not all(isinstance(k, str) for k, _ in pairs):
            raise ValueError("keys must be text and unique")
        return dict(pairs)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    got = yaml.load(data, Strict)  # noqa: S506 - a SafeLoader
    known = {"id", "version", "description", "predicates", "subject_types", "object_types", "uses"}
    if not isinstance(got, dict) or set(got) != known:
        raise ValueError(f"a profile has the keys {sorted(known)}")
    return got


def profile_tables(spark: SparkSession, profile: dict) -> tuple[DataFrame, DataFrame]:
    """(field, allowed), (use, required_type) of a profile."""
    allow = [(f, v) for f in ("predicates", "subject_types", "object_types") for v in profile[f]]
    need = [(u, t) for u, c in profile["uses"].items() for t in (c.get("required_evidence_types") or [None])]
    return spark.createDataFrame(allow, "field string, allowed string"), spark.createDataFrame(need, "use string, required_type string")


def collected(spark: SparkSession, pattern: str, drop: Iterable[str] = ()) -> DataFrame:
    """Many one-object JSON files as rows (folder, json) without volatile members, in the order of their paths."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string,string>").alias("m"))
    kept = F.map_filter("m", lambda k, _: ~k.isin(list(drop) or [""]))
    return rows.orderBy("path").select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.to_json(kept).alias("json"))


def unioned(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def parse_lines(text: str) -> Iterator[dict]:
    return (json.loads(line) for line in text.splitlines() if line.strip())
