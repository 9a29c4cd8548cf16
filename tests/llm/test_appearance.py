import random
import unicodedata

import pyarrow as pa
import pyarrow.compute  # noqa: F401

from corrobora.llm import appearance


def brute(s):
    latin = {c: k for k, v in appearance.LOOKALIKES.items() for c in v}
    out = ""
    for c in unicodedata.normalize("NFD", s):
        d = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Cf":
            continue
        if unicodedata.category(c) == "Zs":
            c = " "
        elif c in appearance.HYPHENS:
            c = "-"
        elif d.startswith(("<wide>", "<narrow>")) or "LIGATURE" in unicodedata.name(c, "") and d.startswith("<compat>"):
            c = unicodedata.normalize("NFKC", c)
        out += "".join(latin.get(x, x) for x in c)
    return unicodedata.normalize("NFC", out)


def test_forms():
    same = [("naïve", "naïve"), ("ﬁne", "fine"), ("ＡＢ１", "AB1"), ("a b", "a b"), ("a​b", "ab"), ("со-оp", "co‑op"), ("ё", "ë"), ("Α", "A")]
    other = [("4⁴", "44"), ("naive", "naïve"), ("A", "a"), ("α", "a"), ("a–b", "a-b"), ("", "a")]
    form = lambda *x: appearance.one_form(pa.array(x)).to_pylist()
    assert all(len(set(form(*p))) == 1 for p in same) and all(len(set(form(*p))) == 2 for p in other)
    assert form(None, "", "​", "plain") == [None, "", "", "plain"]
    assert form("́á̧", "́á̧")[0] == form("́á̧")[0]


def test_against_brute():
    rng = random.Random(2)
    pool = "abceiopxyABCHK аеосрхуіАВСΕΗοéïçñöüàôяйёўжшαβγδ１２ａｂＡ（）．－ﬁﬀﬂ⁴²   ​‍﻿­‐‑–—̧́̈̂̆日本😀"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    assert appearance.one_form(pa.array(texts)).to_pylist() == [brute(t) for t in texts]
    assert appearance.one_form(pa.array(["x", *texts, "y"]).slice(1, 500)).to_pylist() == [brute(t) for t in texts[:500]]


def test_pairs(spark):
    rows = [("s", "1", "fine"), ("s", "2", "ﬁne"), ("s", "3", "fine"), ("s", "3", "fine"), ("t", "4", "ﬁne"), ("s", "5", None), ("s", None, "ﬁne"), ("s", "6", ""), ("s", "7", "​"), ("s", "8", "x" * 50_000), ("s", "9", "x" * 49_999 + "х"), ("s", "1", "fіne")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "src string, id string, text string, f string")
    got = [tuple(r) for r in appearance.same_looking_pairs(df, "src", "id", "text").collect()]
    assert sorted(got) == [("s", "1", "2"), ("s", "1", "3"), ("s", "2", "3"), ("s", "8", "9")]
    assert appearance.same_looking_pairs(df.limit(0), "src", "id", "text").count() == 0
    assert appearance.with_form(df.withColumnRenamed("f", "form"), "text").where("form = 'z'").count() == 0
