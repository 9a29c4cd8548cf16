import gzip
import hashlib
import json

import pytest

from corrobora.sources import readers, sinks
from corrobora.streaming.records import loop_states, stream_records, windowed_counts


def test_strict_json(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": 1, "a": 2}\n{"a": NaN}\n' + "[" * 101 + "]" * 101 + "\nx\n")
    got = readers.read_json_records(spark, str(tmp_path / "r.jsonl")).collect()
    assert [r.problem for r in got] == [None, "invalid", "invalid", "deep", "invalid"]


def test_snapshots(spark, tmp_path):
    for body, bad in ((b"one", False), (b"two", True)):
        name = hashlib.sha256(b"other" if bad else body).hexdigest()
        (tmp_path / f"{name}.txt").write_bytes(body)
    (tmp_path / f"{hashlib.sha256(b'zip').hexdigest()}.txt.gz").write_bytes(gzip.compress(b"zip"))
    (tmp_path / "readme.txt").write_text("x")
    got = {bytes(r.content): r.verified for r in readers.read_snapshots(spark, str(tmp_path)).collect()}
    assert got == {b"one": True, b"two": False, b"zip": True}


def test_delimited(spark):
    df = spark.createDataFrame([(1, 'a,b\n1,"x, ""y"""\n2\n'), (2, "a\tb\n 3 \t4"), (3, None), (4, "")], "k int, content string")
    got = {(r.k, r.row, r.column): r.value for r in readers.parse_delimited(df, "content").collect()}
    assert got == {(1, 0, "a"): "1", (1, 0, "b"): 'x, "y"', (1, 1, "a"): "2", (1, 1, "b"): "", (2, 0, "a"): "3", (2, 0, "b"): "4"}


def test_obo(spark, tmp_path):
    text = 'format-version: 1.2\nontology: cl\n\n[Term]\nid: CL:1\nname: T cell\nsynonym: "T \\"lymphocyte\\"" EXACT []\nsynonym: "near" RELATED []\nis_a: CL:0 ! cell\nrelationship: part_of X:1 ! x\nreplaced_by: CL:9\n\n[Typedef]\nid: part_of\n\n[Term]\nid: CL:2\nname: old\nis_obsolete: true\ndisjoint_from: CL:1 ! T cell\n'
    (tmp_path / "x.obo").write_text(text)
    a, b = sorted(readers.read_obo(spark, str(tmp_path / "x.obo")).collect(), key=lambda r: r.id)
    assert (a.name, a.synonyms, a.parents, [tuple(x) for x in a.relations], a.replaced_by, a.obsolete) == ("T cell", ['T "lymphocyte"'], ["CL:0"], [("part_of", "X:1")], ["CL:9"], False)
    assert (b.name, b.obsolete, b.disjoint) == ("old", True, ["CL:1"])


def test_article(spark):
    xml = "<article><front><article-title>A <i>b</i></article-title></front><body><p id='p1'>One  <b>two</b></p></body></article>"
    got = spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string").select(readers.article_blocks("x").alias("b")).collect()
    assert [(x.id, x.kind, x.text) for x in got[0].b] == [("n2", "title", "A b"), ("p1", "p", "One two")] and got[1].b is None and got[2].b is None


def test_resolvers(spark):
    rows = [
        ("ncbi", {"result": {"uids": ["7"], "7": {"title": "N", "pubtype": ["Retracted Publication"]}}}, True, "N", True),
        ("ncbi", {"result": {"uids": []}}, False, None, False),
        ("europepmc", {"resultList": {"result": [{"title": "E", "isOpenAccess": "Y", "commentCorrectionList": {"commentCorrection": [{"type": "Retraction in"}]}}]}}, True, "E", True),
        ("crossref", {"message": {"title": ["C"], "DOI": "10.1/x", "update-to": [{"type": "correction"}]}}, True, "C", False),
        ("crossref", {}, False, None, False),
    ]
    df = spark.createDataFrame([(k, r[0], json.dumps(r[1])) for k, r in enumerate(rows)], "k int, resolver string, body string")
    got = readers.resolver_facts(df, "resolver", "body").orderBy("k").collect()
    assert [(r.found, r.title, r.retracted) for r in got] == [r[2:] for r in rows]


def test_profile(spark):
    base = "id: a\nversion: '1'\ndescription: d\npredicates: [p]\nsubject_types: []\nobject_types: [o]\nuses:\n  u: {required_evidence_types: [t]}\n  v: {}\n"
    allow, need = readers.profile_tables(spark, readers.load_profile(base))
    assert {tuple(r) for r in allow.collect()} == {("predicates", "p"), ("object_types", "o")} and {tuple(r) for r in need.collect()} == {("u", "t"), ("v", None)}
    for bad in (base + "id: b\n", base + "more: 1\n", "id: a\n"):
        with pytest.raises(ValueError):
            readers.load_profile(bad)


def test_csv_lines_and_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n', encoding="utf-8-sig")
    assert readers.read_exact_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()[0].b == "x\ny"
    with pytest.raises(ValueError):
        readers.read_exact_csv(spark, str(tmp_path / "a.csv"), ["a"])
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n{"models": ["m"]}\n')
    rows, trailer = readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), "x int")
    assert rows.count() == 1 and trailer.count() == 1
    for folder in ("m1", "m2"):
        (tmp_path / "runs" / folder).mkdir(parents=True)
        (tmp_path / "runs" / folder / "e.json").write_text(json.dumps({"a": folder, "seconds": 3}))
    assert [(r.folder, r.json) for r in readers.collected(spark, str(tmp_path / "runs/*/*.json"), ["seconds"]).collect()] == [("m1", '{"a":"m1"}'), ("m2", '{"a":"m2"}')]
    lines = spark.createDataFrame([("#x\ty",), ("1\t2",)], "value string")
    assert readers.parse_headed(lines, "value", ["y", "z"]).collect()[0].asDict() == {"y": "2", "z": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "o")
    sinks.write_new(df, out)
    for path, inputs in ((out, ()), (str(tmp_path / "p"), (str(tmp_path / "p"),))):
        with pytest.raises(Exception):  # noqa: B017
            sinks.write_new(df, path, inputs=inputs)
    table = str(tmp_path / "t")
    doubled = lambda d: d.groupBy("k").count().where("count > 1")
    sinks.append_checked(df, table, df.limit(0), doubled)
    with pytest.raises(ValueError):
        sinks.append_checked(df, table, spark.read.parquet(table), doubled)
    assert spark.read.parquet(table).count() == 2 and sinks.value_hash(df) == sinks.value_hash(df.orderBy("v").repartition(3))
    assert sinks.output_manifest(spark, out).count() > 0 and sinks.markdown([{"a": 1}]) == "| a |\n| --- |\n| 1 |"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"a": 1}\nx\n')
    q = stream_records(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.problem or "" for r in spark.table("got").collect()) == ["", "invalid"]
    for k, rows in enumerate(([("r", 1, "rejected"), ("s", 1, "admitted")], [("r", 2, "rejected"), ("s", 2, "rejected"), ("r", 3, "rejected"), ("r", 4, "admitted")])):
        spark.createDataFrame(rows, "record_id string, attempt int, status string").coalesce(1).write.mode("append").json(str(tmp_path / f"at/{k}"))
    src = spark.readStream.schema("record_id string, attempt int, status string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "at"))
    q = loop_states(src).writeStream.format("memory").queryName("loop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("loop").collect()) == [("r", 1, "rejected", False), ("r", 2, "rejected", False), ("r", 3, "rejected", True), ("s", 1, "admitted", True)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "at string, kind string").selectExpr("timestamp(at) as at", "kind")
    assert sorted(r.n for r in windowed_counts(events, "at", "kind").collect()) == [1, 2]
