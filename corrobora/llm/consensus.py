"""Consensus of several annotators' labels by a community confusion model.

Annotators belong to a few communities, each with a confusion matrix per label field; an annotator's own matrix is drawn
around that of the community, so that annotators with few labels lean on it. Variational updates go back and forth
between the truth of the units and the matrices. The truths of a unit's fields share one joint prior that is learned
too. Votes and annotators stay tables. Votes are dealt and sorted by unit once; a round joins the annotators' matrices
to them, sums per unit in a window that needs no exchange, and sums per annotator, of which alone rows are moved. Only
communities x fields x labels x labels sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, cut_by

#: The labels of each field.
FIELDS = {"admission_label": ("admitted", "review_required", "rejected"), "mapping_label": ("correct", "uncertain", "incorrect")}
UNIT = ("case_id", "requested_use")
ROUNDS, STRENGTH = 30, 12.0
#: Rounds end when no chance in a community's matrix or the prior moves by more.
SETTLED = 0.002
#: Annotators (times fields) whose matrices, some 100 bytes each, are sent to every task.
BROADCAST_PEOPLE = 100_000
#: Chance of the right label in a community at the start; they move from there.
START = (0.92, 0.75, 0.5, 0.2)


def plain_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"(?U)[\s​﻿]+", " "))), r"[\s\-_]+", "_")


def votes(annotations: DataFrame, unit: Sequence[str], reviewer: str, fields: dict[str, Sequence[str]]) -> DataFrame:
    """(unit.., f, r, l, w): one row per unit, field, reviewer and different label. Unknown spellings, missing labels and
    rows with a null unit are left out; a reviewer with several labels in a unit shares one vote among them. A null
    reviewer counts as one of its own ('')."""
    known = F.create_map(*[F.lit(x) for k, (_, names) in enumerate(fields.items()) for l, name in enumerate(names) for x in (f"{k}:{name}", l)])
    some = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.concat(F.lit(f"{k}:"), plain_label(F.col(c))).alias("v")) for k, c in enumerate(fields)])).alias("x")
    rows = annotations.select(*unit, F.coalesce(F.col(reviewer), F.lit("")).alias("r"), some).select(*unit, "r", F.col("x.f").alias("f"), known[F.col("x.v")].alias("l"))
    for c in unit:
        rows = rows.where(F.col(c).isNotNull())
    lists = rows.where("l is not null").groupBy(*unit, "f", "r").agg(F.collect_set("l").alias("ls"))
    return lists.select(*unit, "f", "r", F.explode("ls").alias("l"), (1.0 / F.size("ls")).alias("w"))


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    return np.log(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1.0 / (x + k) for k in range(6))


def _log_mean(alpha: np.ndarray) -> np.ndarray:
    """Expected log probabilities of Dirichlet rows (last axis: given labels)."""
    return _digamma(alpha) - _digamma(alpha.sum(-1, keepdims=True))


def _start(k: int) -> np.ndarray:
    """Dirichlet counts of the communities' matrices [community, truth, label] at the start."""
    eye = np.eye(k)
    return np.stack([30 * (p * eye + (1 - p) / max(k - 1, 1) * (1 - eye)) for p in START])


def fit(votes_df: DataFrame, unit: Sequence[str], sizes: Sequence[int], rounds: int = ROUNDS, strength: float = STRENGTH) -> tuple[DataFrame, DataFrame]:
    """(unit.., q: array per field of the posterior of its labels); (f, r, n, theta: expected matrix, flat, q_z: posterior
    of the communities)."""
    v = cut_by(votes_df, *unit)
    kmax, nc = max(sizes), len(START)
    states = list(product(*[range(k) for k in sizes]))
    community = {f: _start(k) for f, k in enumerate(sizes)}
    mix = {f: np.ones(nc) for f in range(len(sizes))}
    prior = np.ones(len(states))

    def matrices(stats: pd.DataFrame, alpha: dict, weight: dict) -> pd.DataFrame:
        rows = []
        for f, part in stats.groupby("f"):
            k = sizes[f]
            n = np.stack([np.array(x, float) for x in part["n"]]).reshape(-1, kmax, kmax)[:, :k, :k]
            log_c = _log_mean(alpha[f])
            score = np.einsum("rtl,ctl->rc", n, log_c) + np.log(weight[f] / weight[f].sum())
            z = np.exp(score - score.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            mean = alpha[f] / alpha[f].sum(-1, keepdims=True)
            own = strength * np.einsum("rc,ctl->rtl", z, mean) + n
            flat = lambda m: [x.ravel().tolist() for x in np.pad(m, ((0, 0), (0, kmax - k), (0, kmax - k)))]
            rows.append(pd.DataFrame({"f": part["f"].to_numpy(), "r": part["r"].to_numpy(), "n": flat(n), "lp": flat(_log_mean(own)), "theta": flat(own / own.sum(-1, keepdims=True)), "q_z": z.tolist(), "j": part["j"].tolist()}))
        return pd.concat(rows, ignore_index=True)

    shape = "f int, r string, n array<double>, lp array<double>, theta array<double>, q_z array<double>, j array<double>"

    def update(stats: DataFrame) -> DataFrame:
        alpha, weight = dict(community), dict(mix)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield matrices(pdf, alpha, weight)

        return stats.mapInPandas(run, shape)

    zero = F.array_repeat(F.lit(0.0), kmax * kmax)
    inside = Window.partitionBy(*unit)

    def posterior(people: DataFrame) -> DataFrame:
        """Votes with `j`, the posterior of the joint truth of their unit, and `q`, that of each field."""
        lp = lambda t: F.col("w") * F.element_at("lp", F.lit(t * kmax + 1) + F.col("l"))
        # the prior comes as a column, so that every round runs the same compiled code
        own = people.select("f", "r", "lp", F.array(*[F.lit(float(x)) for x in np.log(prior / prior.sum())]).alias("prior"))
        said = v.join(F.broadcast(own) if few else own, ["f", "r"])
        sums = [F.coalesce(F.sum(F.when(F.col("f") == f, lp(t))).over(inside), F.lit(0.0)).alias(f"s_{f}_{t}") for f, k in enumerate(sizes) for t in range(k)]
        said = said.select(*v.columns, "prior", *sums, F.count("*").over(inside).alias("votes"))
        logs = [sum((F.col(f"s_{f}_{t}") for f, t in enumerate(s)), F.element_at("prior", i + 1)) for i, s in enumerate(states)]
        j = _once(said, j=F.array(*logs))
        j = _once(j.withColumnRenamed("j", "j0"), j1=F.transform("j0", lambda x: F.exp(x - F.array_max("j0"))))
        j = _once(j, total=F.aggregate("j1", F.lit(0.0), lambda a, x: a + x))
        j = _once(j, j=F.transform("j1", lambda x: x / F.col("total")))
        q = F.array(*[F.array(*[sum((F.element_at("j", i + 1) for i, s in enumerate(states) if s[f] == t), F.lit(0.0)) if t < k else F.lit(0.0) for t in range(kmax)]) for f, k in enumerate(sizes)])
        return _once(j.select(*v.columns, "votes", "j"), q=q)

    none = lambda n: F.array_repeat(F.lit(0.0), n)
    people = cut(update(v.select("f", "r").distinct().select("f", "r", none(kmax * kmax).alias("n"), none(len(states)).alias("j"))))
    few = people.count() <= BROADCAST_PEOPLE  # else the votes are dealt by annotator and back in each round
    for _ in range(rounds):
        at = lambda t: F.element_at(F.element_at("q", F.col("f") + 1), t + 1) * F.col("w")
        n = F.array(*[F.sum(F.when(F.col("l") == l, at(t)).otherwise(0.0)) for t in range(kmax) for l in range(kmax)]).alias("n")
        people = cut(update(posterior(people).groupBy("f", "r").agg(n, F.array(*[F.sum(F.element_at("j", i + 1) / F.col("votes")) for i in range(len(states))]).alias("j"))))
        of_c = people.groupBy("f").agg(
            *[F.sum(F.element_at("q_z", c + 1) * F.element_at("n", i + 1)).alias(f"n_{c}_{i}") for c in range(nc) for i in range(kmax * kmax)],
            *[F.sum(F.element_at("q_z", c + 1)).alias(f"z_{c}") for c in range(nc)],
            *[F.sum(F.element_at("j", i + 1)).alias(f"j_{i}") for i in range(len(states))],
        ).collect()
        before = np.concatenate([*[(a / a.sum(-1, keepdims=True)).ravel() for a in community.values()], prior / prior.sum()])
        prior = 1.0 + sum((np.array([row[f"j_{i}"] for i in range(len(states))]) for row in of_c), np.zeros(len(states)))
        for row in of_c:
            k = sizes[row["f"]]
            n = np.array([[row[f"n_{c}_{i}"] for i in range(kmax * kmax)] for c in range(nc)]).reshape(nc, kmax, kmax)[:, :k, :k]
            community[row["f"]] = _start(k) / 10 + n
            mix[row["f"]] = 1.0 + np.array([row[f"z_{c}"] for c in range(nc)])
        after = np.concatenate([*[(a / a.sum(-1, keepdims=True)).ravel() for a in community.values()], prior / prior.sum()])
        if np.abs(after - before).max() < SETTLED:
            break
    return posterior(people).groupBy(*unit).agg(F.first("q").alias("q")), people


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def consensus(annotations: DataFrame, unit: Sequence[str] = UNIT, reviewer: str = "reviewer_id", fields: dict[str, Sequence[str]] = FIELDS) -> DataFrame:
    """(unit.., label_field, label, probability, agreement, n_votes, n_labels) of every unit and field with a vote.

    `agreement` is the share of votes for the label, `n_labels` the number of different labels given. Equal posteriors
    go to the label listed first. Repeated rows count once."""
    v = cut(votes(annotations, unit, reviewer, fields))
    truth, _ = fit(v, unit, [len(x) for x in fields.values()])
    # every (unit, field) is one row of few columns, so a unit with very many votes is summed before it is joined
    given = v.groupBy(*unit, "f").agg(F.sum("w").alias("n"), F.count_distinct("l").alias("n_labels"), *[F.sum(F.when(F.col("l") == k, F.col("w")).otherwise(0.0)).alias(f"v_{k}") for k in range(max(len(x) for x in fields.values()))])
    both = given.join(truth, list(unit)).withColumn("p", F.element_at("q", F.col("f") + 1)).withColumn("best", F.array_position("p", F.array_max("p")).cast("int"))
    names = F.array(*[F.array(*[F.lit(x) for x in labels]) for labels in fields.values()])
    titles = F.array(*[F.lit(c) for c in fields])
    mine = F.element_at(F.array(*[F.col(f"v_{k}") for k in range(max(len(x) for x in fields.values()))]), F.col("best"))
    return both.select(*unit, F.element_at(titles, F.col("f") + 1).alias("label_field"), F.element_at(F.element_at(names, F.col("f") + 1), F.col("best")).alias("label"), F.array_max("p").alias("probability"), (mine / F.col("n")).alias("agreement"), F.col("n").alias("n_votes"), "n_labels")


def reliability(annotations: DataFrame, unit: Sequence[str] = UNIT, reviewer: str = "reviewer_id", fields: dict[str, Sequence[str]] = FIELDS) -> DataFrame:
    """(reviewer_id, label_field, n_labels, reliability, community): the mean chance of the right label over the truths,
    and the likeliest community, of every reviewer and field."""
    sizes = [len(x) for x in fields.values()]
    _, people = fit(votes(annotations, unit, reviewer, fields), unit, sizes)
    kmax = max(sizes)
    diagonal = F.when(F.lit(False), 0.0)
    for f, k in enumerate(sizes):
        diagonal = diagonal.when(F.col("f") == f, sum((F.element_at("theta", t * kmax + t + 1) for t in range(k)), F.lit(0.0)) / k)
    return people.select(F.col("r").alias("reviewer_id"), F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("f") + 1).alias("label_field"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("n_labels"), diagonal.alias("reliability"), (F.array_position("q_z", F.array_max("q_z")) - 1).cast("int").alias("community"))
