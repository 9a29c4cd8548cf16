import random

from corrobora.llm import consensus

FIELDS = {"admission_label": consensus.FIELDS["admission_label"]}


def simulated(n_units=400, seed=1):
    rng = random.Random(seed)
    labels = FIELDS["admission_label"]
    skill = {f"good{k}": 0.9 for k in range(6)} | {f"bad{k}": 0.1 for k in range(8)} | {"rare": 0.9}
    rows, truth = [], {}
    for u in range(n_units):
        t = truth[f"c{u}", "use"] = rng.choice(labels)
        for r in rng.sample([x for x in skill if x != "rare"], 5) + (["rare"] if u < 6 else []):
            y = t if rng.random() < skill[r] else rng.choice([x for x in labels if x != t])
            rows.append((f"c{u}", "use", r, rng.choice([y, y.upper(), f" {y} ", y.replace("_", "-")])))
    return rows, truth


def test_beats_majority(spark):
    rows, truth = simulated()
    df = spark.createDataFrame(rows + rows[:50], "case_id string, requested_use string, reviewer_id string, admission_label string").selectExpr("*", "'q' as f", "1 as l")
    got = {(r.case_id, r.requested_use): r for r in consensus.consensus(df, fields=FIELDS).collect()}
    assert set(got) == set(truth)
    right = sum(got[u].label == t for u, t in truth.items()) / len(truth)
    votes = {}
    for c, use, _, y in rows:
        votes.setdefault((c, use), []).append(y.strip().lower().replace("-", "_"))
    majority = sum(max(sorted(set(v)), key=v.count) == truth[u] for u, v in votes.items()) / len(truth)
    assert right > majority + 0.1 and right > 0.85
    rel = {r.reviewer_id: r.reliability for r in consensus.reliability(df, fields=FIELDS).collect()}
    assert min(rel[f"good{k}"] for k in range(6)) > 0.75 > 0.4 > max(rel[f"bad{k}"] for k in range(8)) and rel["rare"] > 0.5
    assert all(0 <= r.agreement <= 1 and r.n_labels >= 1 for r in got.values())


def test_edges(spark):
    rows = [("a", "u", "r1", "admitted"), ("a", "u", "r2", None), ("b", "u", "r1", "n/a"), ("c", "u", None, "Rejected "), ("d", None, "r1", "admitted"), ("e", "u", "r1", "admitted"), ("e", "u", "r1", "rejected"), ("f", "u", "r1", "x" * 10_000)]
    df = spark.createDataFrame(rows, "case_id string, requested_use string, reviewer_id string, admission_label string")
    got = {r.case_id: r for r in consensus.consensus(df, fields=FIELDS).collect()}
    assert set(got) == {"a", "c", "e"} and got["e"].n_labels == 2 and got["c"].label == "rejected"
    assert consensus.consensus(df.limit(0), fields=FIELDS).count() == 0 and consensus.reliability(df.limit(0), fields=FIELDS).count() == 0
