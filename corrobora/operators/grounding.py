"""Comparison of what records claim with reference tables. Each check is one DataFrame with a code per row (null where
the claim holds), so that what is verified and what is found wrong are two filters over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HGVS, label_key, same_value
from ..tables import cut
from . import hierarchy


def cascade(*steps: tuple[Column, str]) -> Column:
    """The code of the first condition that holds; null if none does. A null condition doesn't hold."""
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])
    for condition, code in steps[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), code)
    return out


def term_checks(claims: DataFrame, terms: DataFrame, prefix: str, root: str | None = None) -> DataFrame:
    """Adds `code` to claims (.., term_id, label): 'prefix', 'unknown', 'obsolete', 'label', 'root'. A label may be the
    term's name or any synonym, but for case, punctuation and plural."""
    names = terms.where("id is not null").groupBy(F.col("id").alias("_id")).agg(
        F.max(F.coalesce("obsolete", F.lit(False))).alias("_obsolete"),
        F.array_distinct(F.flatten(F.collect_set(F.concat(F.array(F.coalesce("name", F.lit(""))), F.coalesce("synonyms", F.array().cast("array<string>")))))).alias("_names"),
    )
    df = claims.join(names, claims["term_id"] == names["_id"], "left")
    under = F.lit(True)
    if root is not None:
        _, edges = hierarchy.term_edges(terms)
        inside = hierarchy.under(terms.where(F.col("id") == root).select(F.col("id").alias("node")).distinct(), cut(edges)).select(F.col("node").alias("_under"))
        df = df.join(inside, df["term_id"] == inside["_under"], "left")
        under = F.col("_under").isNotNull()
    known = F.exists(F.col("_names"), lambda n: label_key(n) == label_key(F.col("label")))
    code = cascade((~F.col("term_id").startswith(prefix + ":"), "prefix"), (F.col("_id").isNull(), "unknown"), (F.col("_obsolete"), "obsolete"), (F.col("label").isNotNull() & ~known, "label"), (~under, "root"))
    return df.select(*claims.columns, code.alias("code"))


def symbol_checks(claims: DataFrame, genes: DataFrame, symbol: str) -> DataFrame:
    """Adds `code` to claims: null for an approved symbol, 'renamed' for a former symbol or alias, 'case' for one that
    differs in case only, else 'unknown'."""
    from .packed import symbol_values

    g = genes.where("symbol is not null")
    exact = g.where("status = 'Approved'").select(F.col("symbol").alias("_a")).distinct()
    renamed = g.select(F.explode(F.concat(symbol_values(F.col("prev_symbol")), symbol_values(F.col("alias_symbol")))).alias("_r")).distinct()
    folded = g.where("status = 'Approved'").select(F.lower("symbol").alias("_f")).distinct()
    s = F.col(symbol)
    df = claims.join(exact, s == F.col("_a"), "left").join(renamed, s == F.col("_r"), "left").join(folded, F.lower(s) == F.col("_f"), "left")
    code = F.when(F.col("_a").isNotNull(), F.lit(None).cast("string")).when(F.col("_r").isNotNull(), "renamed").when(F.col("_f").isNotNull(), "case").otherwise("unknown")
    return df.select(*claims.columns, code.alias("code"))


def variant_checks(claims: DataFrame, hgvs: str, sequences: DataFrame, builds: Column) -> DataFrame:
    """Adds `code` to claims: 'form', 'version', 'unknown' sequence, other 'build' than the record's (array `builds`,
    empty for any), position 'beyond' the end. `sequences`: (accession, build, length)."""
    part = lambda k: F.regexp_extract(F.col(hgvs), HGVS, k)
    df = claims.withColumn("_acc", F.concat_ws(".", part(1), part(2)))
    df = df.join(sequences.select(F.col("accession").alias("_s"), F.col("build").alias("_b"), F.col("length").alias("_n")), F.col("_acc") == F.col("_s"), "left")
    place = F.regexp_extract(part(4), r"^(\d+)", 1).try_cast("long")
    chromosome = part(1).startswith("NC_")
    code = cascade(
        (~F.col(hgvs).rlike(HGVS), "form"), (part(2) == "", "version"), (chromosome & F.col("_s").isNull(), "unknown"),
        (chromosome & (F.size(builds) > 0) & ~F.array_contains(builds, F.col("_b")), "build"), (chromosome & (part(3) == "g") & (F.col("_n") > 0) & (place > F.col("_n")), "beyond"),
    )
    return df.select(*claims.columns, code.alias("code"))


def row_checks(claims: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(claim, code): claims in long form (claim, kind 'key' or 'value', column, value) against a table in long form
    (row, column, value): 'column' unknown, 'none' or 'many' rows with the keys, 'wrong' values, else null.

    Keys meet rows by column and, where both are numbers, by neighbouring whole numbers, else by folded text; the exact
    comparison to the decimals of the claim follows."""
    bucket = lambda v: F.coalesce(F.floor(v.try_cast("double")).cast("string"), F.lower(F.trim(v)))
    unknown = claims.where(~F.col("column").isin(columns)).select("claim").distinct().withColumn("code", F.lit("column"))
    sound = claims.join(unknown.select("claim"), "claim", "left_anti")
    keys = sound.where("kind = 'key'").select("claim", "column", F.col("value").alias("asked"))
    number = F.floor(F.col("asked").try_cast("double"))
    near = F.when(number.isNotNull(), F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: (number + k).cast("string"))).otherwise(F.array(F.lower(F.trim("asked"))))
    held = rows.select("row", "column", "value", bucket(F.col("value")).alias("b"))
    met = keys.withColumn("b", F.explode(near)).join(held, ["column", "b"]).where(same_value(F.col("asked"), F.col("value"))).groupBy("claim", "row").agg(F.count_distinct("column").alias("n"))
    all_keys = keys.groupBy("claim").agg(F.count_distinct("column").alias("need"))
    hit = met.join(all_keys, "claim").where("n = need").groupBy("claim").agg(F.count("*").alias("rows"), F.min("row").alias("row"))
    wrong = sound.where("kind = 'value'").select("claim", "column", F.col("value").alias("asked")).join(hit.where("rows = 1"), "claim").join(rows, ["row", "column"]).where(~same_value(F.col("asked"), F.col("value"))).select("claim").distinct().withColumn("bad", F.lit(True))
    out = all_keys.select("claim").join(hit, "claim", "left").join(wrong, "claim", "left")
    return out.select("claim", cascade((F.col("rows").isNull(), "none"), (F.col("rows") > 1, "many"), (F.col("bad"), "wrong")).alias("code")).unionByName(unknown)


def outcome_class(answers: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds `outcome` to answers (truth, answer): 'invalid', 'exact', 'coarser', 'finer' or 'wrong' by the hierarchy."""
    good = terms.where("not coalesce(obsolete, false)").select(F.col("id").alias("_id")).distinct()
    asked = answers.select(F.explode(F.array("answer", "truth")).alias("node")).where("node is not null").distinct()
    pairs = cut(hierarchy.ancestors(asked, hierarchy.term_edges(terms)[1]).select(F.col("above").alias("_up"), F.col("node").alias("_down")))
    df = answers.join(good, F.col("answer") == F.col("_id"), "left")
    up = pairs.select(F.col("_up").alias("_u1"), F.col("_down").alias("_d1"))
    df = df.join(up, (F.col("answer") == F.col("_u1")) & (F.col("truth") == F.col("_d1")), "left").join(pairs, (F.col("truth") == F.col("_up")) & (F.col("answer") == F.col("_down")), "left")
    outcome = F.when(F.col("_id").isNull(), "invalid").when(F.col("answer") == F.col("truth"), "exact").when(F.col("_u1").isNotNull(), "coarser").when(F.col("_up").isNotNull(), "finer").otherwise("wrong")
    return df.select(*answers.columns, outcome.alias("outcome"))


def declared_disjoint(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """The (a, b) pairs of which some ancestors are declared disjoint, in either direction."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    up = cut(hierarchy.ancestors(asked, hierarchy.term_edges(terms)[1]).select(F.col("node").alias("n"), F.col("above").alias("up")))
    said = terms.select(F.col("id").alias("x"), F.explode("disjoint").alias("y")).where("y is not null").distinct()
    both = said.unionByName(said.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    a = pairs.select("a", "b").distinct().join(up.withColumnsRenamed({"n": "a", "up": "x"}), "a").join(both, "x").select("a", "b", "y")
    return a.join(up.withColumnsRenamed({"n": "b", "up": "y"}), ["b", "y"]).select("a", "b").distinct()
