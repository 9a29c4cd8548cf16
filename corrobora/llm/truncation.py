"""Texts cut off before their end, by source: censored length distributions combined with the evidence of the ending.

Texts a field limit cut all have the limit's length, so for lengths they are right-censored observations. Per source a
log-normal distribution is fitted by maximum likelihood, texts at a candidate limit counting as "at least so long"; it
tells how many texts would have that very length by themselves, hence the log-odds that a text there was cut. What an
ending says (a mark of omission, an open sentence or bracket, a list, table row, address or signature, a closed sentence)
isn't set but learned: texts at limits, whose odds of a cut the lengths tell, show how cut texts end, the others how
whole ones do. Expectation and maximisation over the counts of (source, limit, ending) learns both, the cuts' endings
by source (systems mark and tear texts each in their own way) around those of all, and each source's rate of cuts away
from limits. Both kinds of evidence are added as log-odds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut

#: What systems put after a cut.
MARKS = r"(?:\s*(?:\[\s*(?:…|\.{3})\s*\]|…|\.{3}|\((?:more|continued|cont\.|truncated)\)|\[(?:more|continued|cont\.|truncated|cut)\]|<truncated>|�+))+$"
#: Characters that are blank at the end of a text.
BLANKS = " \t\r\n\u00a0\u2007\u202f\u200b\ufeff"
#: Abbreviations whose point doesn't end a sentence.
ABBREVIATIONS = r"(?i)(?:^|[\s(])(?:fig|figs|e\.g|i\.e|cf|vs|approx|dr|no|resp|eq|ref|suppl|et al)\.$"
#: How cut and whole texts end before any are seen, which weighs as much as WEAK texts of each.
CUT_ENDS = {"marked": 0.2, "torn": 0.1, "open": 0.6, "listed": 0.07, "closed": 0.03}
WHOLE_ENDS = {"marked": 0.002, "torn": 0.003, "open": 0.015, "listed": 0.18, "closed": 0.8}
WEAK = (50.0, 200.0)
#: Cut texts whose endings weigh as much as those of all sources against a source's own.
SHARED = 50.0
#: Rounds end when no log-odds of an ending moves by SETTLED, at the latest after ROUNDS.
ROUNDS, SETTLED = 25, 0.02
#: A source's rate of cuts away from limits before any text of it is seen, as weak as ten texts.
RATE = (0.5, 9.5)
LIKELY, LEAST, EXCESS = 0.5, 5, 6.0


def endings(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, chars, bytes, ending) of every text; null texts are left out, a null source is ''.

    Lengths are those of the whole text. Patterns look at its last line, and in that at the last two sentences, which
    are found without a pattern; they have no limit of length.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).where("text is not null")
    t = _once(t, bare=F.rtrim(F.col("text"), F.lit(BLANKS)))
    t = _once(t, line=F.trim(F.substring_index("bare", "\n", -1)))
    t = _once(t, tail=F.substring_index("line", ". ", -2))
    t = _once(t, core=F.rtrim(F.regexp_replace("tail", MARKS, ""), F.lit(BLANKS)))
    t = _once(t, plain=F.regexp_replace("core", r"(?:</\w+>\s*)+$", ""))
    t = _once(t, last=F.regexp_replace("plain", r"^.*[.!?][\"”’»)\]]*\s+(?=\S)", ""))
    return t.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), _class().alias("ending"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _class() -> Column:
    plain, line, last = F.col("plain"), F.col("line"), F.col("last")
    closed = plain.rlike(r"[.!?。][\"”’»)\]]*$") & ~last.rlike(ABBREVIATIONS) & ~plain.rlike(r"\b0\.$") & ~last.rlike(r"\([^()]*$")
    torn = line.rlike(r"^\|") & ~plain.rlike(r"\|$") | last.rlike(r"\([^()]*$") | last.rlike(r"“[^”]*$") | last.rlike(r"<[^<>]*$")
    listed = (
        line.rlike(r"^[|—–*•>#-]")
        | line.rlike(r"^\p{L}[\p{L} ]{1,30}:\s+\S")
        | line.rlike(r"^\S*[\d:/@]\S*$")
        | last.rlike(r"\s[-–•]\s.*\s[-–•]\s")
        | last.rlike(r"[“\"][^”\"]*[”\"]$")
        | plain.rlike(r"[.!?][\"”’»)\]]*\s+[(\[][^()\[\]]*[)\]]$")
        | line.rlike(r"^[(\[][^()\[\]]*[)\]]$")
    )
    only = F.col("bare") == F.col("tail")  # nothing before the tail
    return F.when((F.col("bare") == "") | only & (F.col("core") == ""), "blank").when(F.length("core") < F.length("tail"), "marked").when(closed, "closed").when(torn, "torn").when(listed, "listed").otherwise("open")


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: np.ndarray, held: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of the log lengths by maximum likelihood; `held` texts are only known to reach their limit."""
    x, w = np.log(np.maximum(lengths, 1)), counts.astype(float)
    c, h = np.log(np.maximum(limits, 1)), held.astype(float)
    if w.sum() + h.sum() < 2:
        return 0.0, 1.0
    mean, dev = (w @ x + h @ c) / (w.sum() + h.sum()), 1.0
    for _ in range(rounds):  # the parts beyond the limits are replaced by their expectations
        z = (c - mean) / dev
        tail = np.array([max(0.5 * math.erfc(v / math.sqrt(2)), 1e-12) for v in z])
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first = mean + dev * hazard
        second = dev * dev * (1 + z * hazard) + 2 * mean * first - mean * mean
        n = w.sum() + h.sum()
        new = (w @ x + h @ first) / n
        var = max((w @ (x * x) + h @ second) / n - new * new, 1e-4)
        mean, dev = new, math.sqrt(var)
    return mean, dev


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, length, at_limit): log-odds of a cut, by lengths alone, at every candidate limit of every source.

    Texts are first counted by source, unit and length, so that only counts move. Candidates are lengths where at least
    LEAST texts stand, EXCESS times as many as fall on average on the lengths within a tenth around, most of them
    neither closed nor listed. Marked texts need no limit and aren't counted. A limit in bytes just above one in
    characters is only its shadow.
    """
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])
    counted = (
        ends.where("ending not in ('blank', 'marked')")
        .select("source", "ending", F.inline(units))
        .groupBy("source", "unit", "length")
        .agg(F.count("*").alias("n"), F.count_if(F.col("ending").isin("open", "torn")).alias("odd"), F.count_if(F.col("ending") != "listed").alias("told"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        length, n = pdf["length"].to_numpy(), pdf["n"].to_numpy()
        sums = np.concatenate(([0], np.cumsum(n)))
        around = sums[np.searchsorted(length, length * 1.1, "right")] - sums[np.searchsorted(length, length * 0.9, "left")] - n
        usual = around / np.maximum(np.ceil(length * 0.2), 1)
        odd, told = pdf["odd"].to_numpy(), pdf["told"].to_numpy()
        at = (n >= LEAST) & (n > EXCESS * usual) & (odd >= LIKELY * np.maximum(told, 1))
        same = lambda c: pd.Series([pdf[c].iloc[0]] * int(at.sum()), dtype=object)
        if not at.any():
            return pd.DataFrame({"source": same("source"), "unit": same("unit"), "length": length[at], "at_limit": length[at] * 1.0})
        mean, dev = fit_censored(length[~at], n[~at], length[at], n[at])
        z = (np.log(np.maximum(length[at], 1)) - mean) / dev
        natural = np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * dev * np.maximum(length[at], 1)) * n.sum()
        return pd.DataFrame({"source": same("source"), "unit": same("unit"), "length": length[at], "at_limit": np.log(np.maximum(n[at] - natural, 0.5) / np.maximum(natural, 1e-6))})

    return counted.groupBy("source", "unit").applyInPandas(fit, "source string, unit string, length int, at_limit double")


def learned(cells: DataFrame) -> DataFrame:
    """(source, base, adds): log-odds of a cut of a text away from any limit, and those its ending adds (in the order of
    CUT_ENDS).

    `cells`: (source, at_limit, ending, n), at_limit null away from limits. A source has few cells, so they travel as one
    row per source; a round is a narrow pass over these and one sum per ending."""
    ends = list(CUT_ENDS)
    number = F.create_map(*[F.lit(x) for k, e in enumerate(ends) for x in (e, k)])
    per = cells.groupBy("source").agg(F.collect_list(F.struct("at_limit", number[F.col("ending")].alias("e"), F.col("n").cast("double").alias("n"))).alias("cells"))
    prior = np.array([[d[e] for e in ends] for d in (CUT_ENDS, WHOLE_ENDS)])
    column = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    cut_ends, whole = prior
    now = cut(per.select("source", "cells", F.lit(math.log(RATE[0] / RATE[1])).alias("base"), column(cut_ends).alias("mix")))
    for _ in range(ROUNDS):
        rows = now.withColumn("adds", F.zip_with("mix", column(whole), lambda m, w: F.ln(m / w)))
        chance = lambda c: 1 / (1 + F.exp(-(F.coalesce(c["at_limit"], F.col("base")) + F.get("adds", c["e"]))))
        rows = rows.withColumn("held", F.transform("cells", lambda c: F.struct(c["at_limit"].isNull().alias("off"), c["e"].alias("e"), c["n"].alias("n"), (c["n"] * chance(c)).alias("cut"))))
        total = lambda f: F.aggregate("held", F.lit(0.0), lambda a, c: a + f(c))
        own = F.array(*[total(lambda c, k=k: F.when(c["e"] == k, c["cut"]).otherwise(0.0)) for k in range(len(ends))])
        rows = rows.select("source", "cells", "held", own.alias("own"), total(lambda c: c["cut"]).alias("cuts"), total(lambda c: F.when(c["off"], c["cut"]).otherwise(0.0)).alias("cut_off"), total(lambda c: F.when(c["off"], c["n"]).otherwise(0.0)).alias("all_off"))
        rows = cut(rows)
        sums = {r["e"]: (r["c"], r["w"]) for r in rows.select(F.inline("held")).groupBy("e").agg(F.sum("cut").alias("c"), F.sum(F.col("n") - F.col("cut")).alias("w")).collect()}
        seen = np.array(WEAK)[:, None] * prior + np.array([[sums.get(k, (0.0, 0.0))[side] for k in range(len(ends))] for side in (0, 1)])
        before = np.log(cut_ends / whole)
        cut_ends, whole = seen / seen.sum(axis=1, keepdims=True)
        mix = F.zip_with("own", column(cut_ends), lambda n, p: (n + SHARED * p) / (F.col("cuts") + SHARED))
        now = rows.select("source", "cells", F.ln((F.col("cut_off") + RATE[0]) / (F.col("all_off") - F.col("cut_off") + RATE[1])).alias("base"), mix.alias("mix"))
        if np.abs(np.log(cut_ends / whole) - before).max() < SETTLED:
            break
    return now.select("source", "base", F.zip_with("mix", column(whole), lambda m, w: F.ln(m / w)).alias("adds"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, ending, at_limit, log_odds, truncated, in_sentence) of every document with a text. log_odds are
    those of the text's limit (or its source's rate of other cuts) and its ending; truncated: they are above 0; a blank
    text isn't cut. in_sentence: the text doesn't end as a whole sentence does; one cut at a full stop, right on a limit,
    is truncated but not in_sentence."""
    ends = cut(endings(docs, doc_id, text, source))
    found = cut(limits(ends)).withColumnRenamed("source", "s")
    chars, sizes = (found.where(F.col("unit") == u).select("s", "length", F.col("at_limit").alias(f"at_{u}")) for u in ("chars", "bytes"))
    near = (F.col("b.s") == F.col("c.s")) & (F.col("c.length") < F.col("b.length")) & (F.col("c.length") >= 0.9 * F.col("b.length"))
    sizes = sizes.alias("b").join(chars.alias("c"), near, "left_anti")
    for mine, c in ((chars, "chars"), (sizes, "bytes")):
        ends = ends.join(mine, (F.col("source") == F.col("s")) & (F.col(c) == F.col("length")), "left").drop("s", "length")
    ends = ends.select("doc_id", "source", "ending", F.greatest("at_chars", "at_bytes").alias("at_limit"))
    cells = ends.where("ending <> 'blank'").groupBy("source", "at_limit", "ending").agg(F.count("*").alias("n"))
    odds = F.coalesce("at_limit", "base") + F.get("adds", F.array_position(F.array(*[F.lit(e) for e in CUT_ENDS]), F.col("ending")).cast("int") - 1)
    said = ends.join(learned(cells), "source", "left").withColumn("log_odds", F.when(F.col("ending") != "blank", odds))
    return said.select("doc_id", "source", "ending", "at_limit", "log_odds", F.coalesce(F.col("log_odds") > 0, F.lit(False)).alias("truncated"), (~F.col("ending").isin("closed", "blank")).alias("in_sentence"))


def rates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, n_docs, n_truncated, rate) of every source."""
    n = F.count_if("truncated")
    return judged(docs, doc_id, text, source).groupBy("source").agg(F.count("*").alias("n_docs"), n.alias("n_truncated"), (n / F.count("*")).alias("rate"))
