import math
import random

import numpy as np

from corrobora.llm import truncation

SENTENCE = "The expression of ABC1 was associated with relapse in both human and mouse tissue"
WHOLE = [SENTENCE + ".", SENTENCE + ". (n = 12)", SENTENCE + ".\nKeywords: a; b; C1", SENTENCE + ".\n\nReferences\npmid:99100001", SENTENCE + ".\n| gene | pct |\n| A1 | 0.3 |", SENTENCE + ".\n— reviewer rev-1",
         SENTENCE + " (p = 0.8).  \r\n", SENTENCE + ". The curator noted: “no change”", "- A retained - see table B - mapping to C", SENTENCE + ". Further arms are listed ...\n[end of entry]", SENTENCE + "?", "", " \n"]
CUT = [SENTENCE, SENTENCE + ". The exp", SENTENCE + "…", SENTENCE + "...", SENTENCE + " [...]", SENTENCE + ". By contrast, the (more)", SENTENCE + " l�", SENTENCE + ". After (p = 0.", SENTENCE + ". See Fig.", SENTENCE + " <xref", SENTENCE + ".\n| gene | 0."]


def test_endings(spark):
    df = spark.createDataFrame([(k, t, "s", "z") for k, t in enumerate(WHOLE + CUT)] + [(99, None, "s", "z"), (100, SENTENCE * 3000 + ".", None, "z")], "doc_id long, text string, source string, core string")
    got = {r.doc_id: r for r in truncation.judged(df).collect()}
    assert [k for k in range(len(WHOLE)) if got[k].truncated] == [] and [k for k in range(len(WHOLE), len(WHOLE + CUT)) if not got[k].truncated] == []
    assert 99 not in got and got[100].source == "" and not got[100].truncated
    assert truncation.judged(df.limit(0)).count() == 0 and truncation.rates(df).where("source = 's'").first().n_truncated == len(CUT)


def test_limit_found(spark):
    """A list is no evidence by itself, but one that ends where the source cuts off is cut."""
    rng = random.Random(1)
    rows = []
    for k in range(1500):
        text = "".join(f"{rng.choice(['A', 'Bcd', 'Efgh'])} retained - see table {rng.randrange(99)} - " for _ in range(30)) if k % 5 == 0 else " ".join(SENTENCE + "." for _ in range(8))
        whole = text[: max(60, int(rng.lognormvariate(5.2, 0.5)))]
        whole = whole if k % 5 == 0 else whole[: whole.rfind(" ")] + "."
        rows.append((k, whole[:200], "s", len(whole) > 200))
    got = {r.doc_id: r.truncated for r in truncation.judged(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")).collect()}
    wrong = sum(got[k] != c for k, _, _, c in rows)
    assert wrong / len(rows) < 0.02
    lim = truncation.limits(truncation.endings(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string"), "doc_id", "text", "source")).collect()
    assert {(r.unit, r.length) for r in lim} == {("chars", 200), ("bytes", 200)} and min(r.at_limit for r in lim) > 2


def test_fit():
    rng = np.random.default_rng(0)
    x = np.maximum(1, np.exp(rng.normal(6, 0.8, 20_000))).astype(int)
    lengths, counts = np.unique(x[x < 500], return_counts=True)
    mean, dev = truncation.fit_censored(lengths, counts, np.array([500]), np.array([(x >= 500).sum()]))
    assert math.isclose(mean, 6, abs_tol=0.05) and math.isclose(dev, 0.8, abs_tol=0.05)


def test_limit_alone_decides(spark):
    """Texts that end with a full stop right on a limit are cut if far more of them stand there than by themselves; how
    cut and whole texts end is learned, so the same endings off the limit stay whole."""
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        whole = " ".join(rng.choice(["It is so.", "Ok.", "Yes it is.", "We saw A1."]) for _ in range(max(2, int(rng.lognormvariate(3, 0.6)))))
        rows.append((k, whole[:160].rstrip(), "s", len(whole[:160].rstrip()) == 160 < len(whole)))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in truncation.judged(df).collect()}
    closed = [k for k, t, _, c in rows if c and t.endswith(".")]
    assert len(closed) > 50 and all(got[k].truncated and not got[k].in_sentence for k in closed)
    off = [k for k, t, _, _ in rows if len(t) < 150]
    assert sum(got[k].truncated for k in off) == 0
