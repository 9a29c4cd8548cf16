import json

from corrobora.operators import nested

ROWS = [
    (1, {"attempts": [{"citations": [{"pmid": "PMID: 12"}, {"title": "t", "related": [{"pmid": 9}]}, None, {"pmid": 13}], "bioevidence": json.dumps({"codes": ["A", {"rule_id": "B"}]})}, {"citations": {"pmid": "pmid:7"}, "bioevidence": {"codes": "C"}}]}),
    (2, {"citations": [{"pmid": None}, {"pmid": 5}], "bioevidence": {"codes": None}, "results": {"m": {"accepted_beyond_civic": {"n": 1}, "citations": [{"pmid": 3}]}}}),
    (3, {"summary": {"pooled": {"accepted_beyond_civic": {"n": "708"}}, "results": {"pooled": {"accepted_beyond_civic": {"n": 4}}}}}),
    (4, {"attempts": {"citations": [{"pmid": 8}]}}),
    (11, {"report": {"pooled": {"accepted_beyond_civic": {"n": 6}}}, "results": {"pooled": {"accepted_beyond_civic": {"n": 2}}}}),
]
WANT = {
    (1, "citations.pmid", 0, 0, "12"), (1, "citations.pmid", 0, 3, "13"), (1, "bioevidence.codes", 0, 0, "A"), (1, "bioevidence.codes", 0, 1, "B"), (1, "citations.pmid", 1, 0, "7"), (1, "bioevidence.codes", 1, 0, "C"),
    (2, "citations.pmid", 0, 1, "5"), (3, "pooled.accepted_beyond_civic.n", 0, 0, "708"), (4, "citations.pmid", 0, 0, "8"), (11, "pooled.accepted_beyond_civic.n", 0, 0, "6"),
}


def frame(spark):
    rows = [(k, json.dumps(v)) for k, v in ROWS] + [(1, json.dumps(ROWS[0][1])), (5, '{"citations": [{"pmid": 1}'), (6, None), (None, '{"citations": {"pmid": 1}}'), (7, '{"citations": [{"pmid": NaN}]}'), (8, "[]"), (9, '"x"'), (10, "[" * 5000)]
    return spark.createDataFrame(rows, "episode_id long, payload string").selectExpr("*", "'x' as path", "1 as id")


def test_fields(spark):
    assert {tuple(r) for r in nested.episode_fields(frame(spark)).collect()} == WANT
    assert nested.episode_fields(frame(spark)).count() == len(WANT)


def test_flat_table(spark):
    t = nested.json_triples(frame(spark), "episode_id", "payload", nested.LISTS, nested.WRAPPERS)
    flat = nested.flat_table(t, "attempts.citations", {"attempts.citations.pmid": "pmid", "attempts.citations.title": "title"}, 2)
    assert {(r.id, r.pos_0, r.pos_1, r.pmid, r.title) for r in flat.collect()} >= {(1, 0, 0, "PMID: 12", None), (1, 0, 1, None, "t"), (1, 1, 0, "pmid:7", None)}


def test_empty(spark):
    assert nested.episode_fields(frame(spark).limit(0)).count() == 0
