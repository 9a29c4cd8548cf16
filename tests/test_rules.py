"""The fault table: one fault at a time put into a valid record."""

import pytest

from corrobora.operators import findings as R
from corrobora.operators import rules

CONTRACTS = [("summary", ["quote"], [], False, False, False, False), ("panel", ["quote"], ["quote"], True, True, True, True)]
SCHEMAS = {
    "statements": "record_id string, statement_id string, status string, predicate string, subject_type string, object_type string, scope array<string>, author string",
    "items": "record_id string, item_id string, source_id string, kind string, method string, scope array<string>, author string, locator string",
    "sources": "record_id string, source_id string, frozen string, observed string",
    "refs": "record_id string, line_id string, direction string, item_id string",
    "uses": "record_id string, use string",
    "reviews": "record_id string, review_id string, statement_id string, use string, decision string, reviewer string, agent string",
}


def valid():
    return {
        "statements": [["s1", "proposed", "treats", "drug", "disease", ["human"], "w"]],
        "items": [["i1", "a1", "quote", "manual", ["human"], "w", "#p1"]],
        "sources": [["a1", "h", None]],
        "refs": [["l1", "supports", "i1"]],
        "uses": [["summary"]],
        "reviews": [],
    }


def put(table, column, value, row=0):
    return lambda r: r[table][row].__setitem__(column, value)


def more(table, *row):
    return lambda r: r[table].append(list(row))


def panel(*reviews, method="manual"):
    def change(r):
        r["uses"] = [["panel"]]
        r["items"][0][3] = method
        r["reviews"] = [[f"v{k}", "s1", "panel", d, who, agent] for k, (d, who, agent) in enumerate(reviews)]

    return change


GOOD = [("accept", "p1", "human"), ("accept", "m1", "software")]
FAULTS = {
    "none": (lambda r: None, "", "admitted"),
    "observed hash changed": (put("sources", 2, "other"), "BEV002", "rejected"),
    "observed hash the same": (put("sources", 2, "h"), "", "admitted"),
    "status": (put("statements", 1, "superseded"), "BEV001", "rejected"),
    "predicate": (put("statements", 2, "harms"), "BEV003", "rejected"),
    "contradicting line": (lambda r: (more("items", "i2", "a1", "note", "manual", ["human"], "w", "#p2")(r), more("refs", "l2", "contradicts", "i2")(r)), "BEV004", "review_required"),
    "line made neutral": (put("refs", 1, "neutral"), "BEV006|BEV007", "rejected"),
    "extra scope token": (put("items", 4, ["human", "adult"]), "BEV005|BEV006|BEV007", "rejected"),
    "scope in another order": (lambda r: (put("items", 4, ["b", "a"])(r), put("statements", 5, ["a", "b"])(r)), "", "admitted"),
    "type missing": (put("items", 2, "note"), "BEV007", "rejected"),
    "llm": (put("items", 3, "llm_extraction"), "BEV008", "review_required"),
    "match": (put("items", 3, "string_match"), "BEV009", "review_required"),
    "both": (lambda r: (put("items", 3, "llm_extraction")(r), more("items", "i2", "a1", "quote", "string_match", ["human"], "w", "#p2")(r), more("refs", "l1", "supports", "i2")(r)), "BEV013", "review_required"),
    "a good note beside": (lambda r: (put("items", 3, "llm_extraction")(r), more("items", "i2", "a1", "note", "manual", ["human"], "w", "#p2")(r), more("refs", "l1", "supports", "i2")(r)), "BEV008", "review_required"),
    "unused item without source": (more("items", "i2", "gone", "quote", "manual", ["human"], "w", "#p2"), "RECORD_INTEGRITY", "rejected"),
    "dangling reference": (more("refs", "l1", "supports", "i9"), "RECORD_INTEGRITY", "rejected"),
    "doubled reference": (more("refs", "l1", "supports", "i1"), "RECORD_INTEGRITY", "rejected"),
    "doubled scope": (put("statements", 5, ["human", "human"]), "RECORD_INTEGRITY", "rejected"),
    "doubled item": (more("items", "i1", "a1", "quote", "manual", ["human"], "w", "#p2"), "RECORD_INTEGRITY", "rejected"),
    "unknown use": (more("uses", "other"), "RECORD_INTEGRITY", "rejected"),
    "blank locator": (put("items", 6, " "), "SCHEMA", "rejected"),
    "missing id": (put("items", 0, None), "SCHEMA", "rejected"),
    "null type stops the rest": (lambda r: (put("items", 2, None)(r), put("statements", 1, "superseded")(r), more("refs", "l1", "supports", "i9")(r)), "SCHEMA", "rejected"),
    "panel without people": (panel(), "BEV010|BEV020|BEV021", "rejected"),
    "panel": (panel(*GOOD), "BEV020", "review_required"),
    "panel refused": (panel(*GOOD, ("reject", "p2", "human")), "BEV011|BEV020", "rejected"),
    "panel deferred": (panel(*GOOD, ("defer", "p2", "human")), "BEV012|BEV020", "review_required"),
    "own review": (panel(("accept", "p1", "human"), ("accept", "w", "software")), "BEV020|BEV021", "review_required"),
    "other statement": (lambda r: (panel(*GOOD)(r), put("reviews", 1, "s2")(r)), "RECORD_INTEGRITY", "rejected"),
    "undecided review": (lambda r: (panel(*GOOD)(r), put("reviews", 3, "maybe")(r)), "SCHEMA", "rejected"),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = {t: [] for t in SCHEMAS}
    for name, (change, _, _) in FAULTS.items():
        record = valid()
        change(record)
        for t in SCHEMAS:
            rows[t] += [(name, *r) for r in record[t]]
    return {t: spark.createDataFrame(rows[t], SCHEMAS[t]) for t in SCHEMAS}


def profile(spark):
    return spark.createDataFrame(CONTRACTS, "use string, required array<string>, verified array<string>, human boolean, independent boolean, llm_only boolean, match_only boolean"), spark.createDataFrame([("predicates", "treats")], "field string, value string")


def test_fault_table(spark, tables):
    found = rules.findings(tables, *profile(spark))
    decided = R.decide(found, tables["uses"].distinct()).collect()
    got = {}
    for r in decided:
        codes, status = got.get(r.record_id, ("", "admitted"))
        got[r.record_id] = (r.reason_codes or codes, max(status, r.status, key=R.STATUS.index))
    assert got == {name: (codes, status) for name, (_, codes, status) in FAULTS.items()}


def test_grounders(spark, tables):
    from pyspark.sql import functions as F

    says = lambda rule: lambda t: t["items"].select("record_id", "item_id", F.lit(rule).cast("string").alias("rule_id"), F.lit("error").alias("severity"))
    panel_ = {t: df.where("record_id = 'panel'") for t, df in tables.items()}
    verified = rules.findings(panel_, *profile(spark), [rules.Grounder("all", says(None))]).collect()
    assert verified == []
    broken = rules.findings(panel_, *profile(spark), [rules.Grounder("all", says(None)), rules.Grounder("none", says("BEV016"))]).collect()
    assert [(r.rule_id, r.use, r.n) for r in broken] == [("BEV016", None, 1)]


def test_more_constraints_and_empty(spark, tables):
    from pyspark.sql import functions as F

    extra = rules.structure(tables, {"statements": {"author": lambda: F.col("author") == "w"}}).where("slot = 'statements.author'")
    assert extra.count() == len(FAULTS)
    none = {t: df.limit(0) for t, df in tables.items()}
    assert rules.findings(none, *profile(spark)).count() == 0
