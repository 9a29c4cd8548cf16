import random

import numpy as np
import pytest

from corrobora.llm import name_mapping as names


def test_tree_finds_all():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))
    keys, texts = [word() for _ in range(300)] + ["z" * 80], [word() for _ in range(120)] + ["z" * 79, ""]
    tree = names.Tree(keys)
    limits = np.array([rng.randrange(0, 4) for _ in texts])
    got = {(t, tree.keys[k], d) for t, k, d in tree.search(texts, limits)}
    want = {(t, k, d) for t, x in enumerate(texts) if x for k in set(keys) if (d := names._distance(x, k)) <= limits[t]}
    assert got == want
    assert list(names.Tree([]).search(["a"], np.array([1]))) == []


REF = [("R:1", "zuklausert glogisond myocyte", ["GLo-12345", "themena bizades myocyte, naive"], False), ("R:2", "resting plotreile skafigrim neuron", None, False), ("R:3", "fanaerel pazucen neuron", [], True), ("R:4", "zuklausert bereham neuron", [], False), ("R:5", None, [None], None)]
GENES = [("G:1", "ABC1", "Approved", "OLD-7|X2", '"mAL-1"'), ("G:2", "DEF2", "Approved", "", "SHARED9"), ("G:3", "GHI3", "Entry Withdrawn", "ABD4", ""), ("G:4", "KLM4", "Approved", None, "SHARED9, GHI3")]
ASKED = [
    (1, "cell_type", "human Zuklausert-glogisond myocytes", "R:1"), (2, "cell_type", "glogisond myocyte zuklauesrt [confirmed]", "R:1"), (3, "cell_type", "glo 12345 cells", "R:1"), (4, "cell_type", "restingplotreile skafgrim neuron?", "R:2"),
    (5, "cell_type", "fanaerel pazucen neuron", "unmatched"), (6, "cell_type", "zuklausert mocrauvert neuron", "unmatched"), (7, "cell_type", "neuron", "unmatched"), (8, "cell_type", "naive themena bizades (n=12)", "R:1"), (9, "cell_type", None, "unmatched"), (10, "cell_type", "", "unmatched"),
    (11, "gene", "ａｂｃ-１", "G:1"), (12, "gene", "gene old7", "G:1"), (13, "gene", "Hs.MAL1", "G:1"), (14, "gene", "SHARED9", "unmatched"), (15, "gene", "GHI3", "unmatched"), (16, "gene", "ABC1-AS", "unmatched"), (17, "gene", "DEF2 (human)", "G:2"), (18, "tissue", "ABC1", "unmatched"), (19, None, "ABC1", "unmatched"), (20, "cell_type", "q" * 20_000, "unmatched"),
]


@pytest.mark.parametrize("most", [100_000, 2])
def test_map(spark, monkeypatch, most):
    general = frozenset({"myocyte", "neuron", "naive", "resting"}) | frozenset(names.REMARKS)
    monkeypatch.setattr(names, "general_words", lambda *a, **k: general)
    monkeypatch.setattr(names.match_names, "__defaults__", (frozenset(), most))
    q = spark.createDataFrame([r[:3] for r in ASKED] + [ASKED[0][:3]], "case_id long, entity_type string, query_text string").selectExpr("*", "'x' as a", "1 as score")
    ref = spark.createDataFrame(REF, "id string, name string, synonyms array<string>, obsolete boolean")
    genes = spark.createDataFrame(GENES, "hgnc_id string, symbol string, status string, prev_symbol string, alias_symbol string")
    rows = names.map_names(q, ref, genes).collect()
    assert len(rows) == len(ASKED) and {r.case_id: r.ref_id for r in rows} == {r[0]: r[3] for r in ASKED}
    assert names.map_names(q.limit(0), ref, genes).count() == 0
    assert {r.ref_id for r in names.map_names(q, ref.limit(0), genes.limit(0)).collect()} == {"unmatched"}


def test_general_words(spark):
    df = spark.createDataFrame([(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x neuron",) for k in range(300)], "name string")
    assert "neuron" in names.general_words(df) and "waax" not in names.general_words(df)
