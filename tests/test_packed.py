from pyspark.sql import functions as F

from corrobora.operators import packed

LOCATORS = {
    "#p44": ["#p44"], "#p2 #p54": ["#p2", "#p54"], "#p8 | #p73 | #p32": ["#p8", "#p73", "#p32"],
    "Figure 7; lower panel": ["Figure 7; lower panel"], 'cluster=1; "note=check x; row 3"': ["cluster=1", "note=check x; row 3"],
    "page = 13;gene=ABC1;": ["page=13", "gene=ABC1"], "table=Table 2, panel a;page=3": ["table=Table 2, panel a", "page=3"],
    'gene = A / "table=Table 2, panel a" / pct_in=0.8': ["gene=A", "table=Table 2, panel a", "pct_in=0.8"],
    "cluster=17；gene=SGD83": ["cluster=17", "gene=SGD83"], 'note="check a; page=4";page=5': ["note=check a; page=4", "page=5"],
    "a=1\nb=2": ["a=1", "b=2"], "": [], None: [],
}
REFS = {
    '["a", "b; c"]': ["a", "b; c"], "['a', 'b, c']": ["a", "b, c"], '"[\\"a\\", \\"b; c\\"]"': ["a", "b; c"], 'a | "b; c"|': ["a", "b; c"],
    "[]": [], '"author note; sheet 1"': ["author note; sheet 1"], "https://x.example/r/1?s=2, pmid:1": ["https://x.example/r/1?s=2", "pmid:1"], '["", " "]': [], None: [],
}
SYMBOLS = {'"A|B|C"': ["A", "B", "C"], '"A","B"': ["A", "B"], "|A|B|": ["A", "B"], "A | B; C, D|E / F": ["A", "B", "C", "D", "E", "F"], "A": ["A"], "": [], None: []}


def values(spark, texts, split):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    item = F.transform(split(F.col("t")), lambda v: F.regexp_replace(v, r"^([^=]*?)\s*=\s*", "$1="))
    return [r.v for r in df.select("k", item.alias("v")).orderBy("k").collect()]


def test_locators(spark):
    assert values(spark, LOCATORS, packed.locator_values) == list(LOCATORS.values())


def test_references(spark):
    assert values(spark, REFS, packed.reference_values) == list(REFS.values())


def test_symbols(spark):
    assert values(spark, SYMBOLS, packed.symbol_values) == list(SYMBOLS.values())


def test_rows(spark):
    df = spark.createDataFrame([("a", "x=1;x=1", 9), ("a", "x=1;x=1", 9), (None, "x=1;y=2", 9), ("b", "x=1", 9), ("c", None, 9), ("d", "p=1;" * 5000, 9)], "id string, t string, pos int")
    got = sorted((r.row_id, r.pos, r.item) for r in packed.packed_rows(df, "id", packed.locator_values(F.col("t")), "s").collect() if r.row_id != "d")
    assert got == [("a", 0, "x=1"), ("a", 1, "x=1")]
    assert packed.packed_rows(df, "id", packed.locator_values(F.col("t")), "s").where("row_id = 'd'").count() == 5000
    assert packed.packed_rows(df.limit(0), "id", packed.locator_values(F.col("t")), "s").count() == 0


def test_other_locators_are_one_value(spark):
    rows = ["page 3; table=2; gene=TP53", "table=2; gene=TP53", "#p1 #p2", "Table 2, row 4", None, ""]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string")
    assert [r.x for r in df.select("k", packed.locator_values(F.col("v")).alias("x")).orderBy("k").collect()] == [["page 3; table=2; gene=TP53"], ["table=2", "gene=TP53"], ["#p1", "#p2"], ["Table 2, row 4"], [], []]
