"""Names as people type them, mapped to the entries of a reference list through a BK-tree under edit distance.

A name becomes a key: general words (types, states, species, remarks) go, the telling words are joined in order. The
tree holds the reference keys; a search takes a whole Arrow batch of queries down the tree at once, with the distances
of a node to all its queries from one bit-parallel pass over arrays, and prunes by the triangle inequality. It returns
every key within the threshold; the entry is chosen among these. The tree goes to every task while the reference is
counted to be small; beyond that it is built per shard of the reference and the winners of the shards are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packed import symbol_values

BROADCAST_KEYS = 100_000
#: Words that say nothing about which cell type is meant, beside those learned from the reference.
REMARKS = ("human", "mouse", "murine", "primary", "putative", "confirmed", "the", "a", "an", "of", "like", "type", "types", "cell", "cells", "donor", "unknown", "none", "na")
_ASIDE = re.compile(r"\([^)]*\)|\[[^\]]*\]|(?:-\s*)?\bdonor\s*\d+|\bn\s*=\s*\d+")
_GENE_ASIDE = re.compile(r"\((?:human|mouse|homo sapiens|gene|protein)\)|\[[^\]]*\]|^\s*(?:human|gene|hs[.:]|homo sapiens)\s*|\s+(?:gene|protein|mrna)\s*$|[+.?!*]+\s*$", re.I)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def words_of(text: str | None, general: frozenset[str]) -> tuple[tuple[str, ...], frozenset[str], bool]:
    """(telling words, general words seen, whether it is a code). General words glued to others are cut off, and
    misspelt by one letter they still count as general; single letters are left out."""
    tokens = re.findall(r"[^\W_]+", _ASIDE.sub(" ", _plain(text or "")))
    if any(c.isdigit() for t in tokens for c in t):
        return ("".join(t for t in tokens if _singular(t) not in general),), frozenset(), True
    long = sorted((g for g in general if len(g) >= 4), key=len, reverse=True)
    telling, seen = [], set()
    for t in tokens:
        while len(t) > 1 and _singular(t) not in general:
            glued = next((g for g in long if len(t) >= len(g) + 5 and (t.startswith(g) or t.endswith((g, g + "s")))), None)
            if glued is None:
                break
            seen.add(glued)
            t = t[len(glued) :] if t.startswith(glued) else t[: t.rindex(glued)]
        if len(t) > 1:
            near = next((g for g in long if len(g) >= 5 and abs(len(g) - len(t)) <= 2 and _close(_singular(t), g)), None)
            word = _singular(t) if _singular(t) in general else near
            if word:
                seen.add(word)
            else:
                telling.append(t)
    return tuple(telling), frozenset(seen), False


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def _close(a: str, b: str) -> bool:
    """Equal but for one letter changed, added, left out or exchanged with its neighbour."""
    if a == b:
        return True
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def gene_key(text: str | None) -> str:
    raw = _plain(text or "")
    while (cut := _GENE_ASIDE.sub("", raw)) != raw:
        raw = cut
    return "".join(re.findall(r"[^\W_]", raw))


class Tree:
    """BK-tree over distinct keys of up to 64 characters (longer ones are kept aside and compared one by one)."""

    def __init__(self, keys: Iterable[str]):
        self.keys = sorted(set(keys))
        self.alphabet = {c: k for k, c in enumerate(sorted({c for k in self.keys for c in k}), 1)}
        fits = np.array([k for k, key in enumerate(self.keys) if 0 < len(key) <= 64], np.int64)
        self.long = [k for k, key in enumerate(self.keys) if len(key) > 64]
        codes, lengths = self.encode(self.keys)
        self.root = self._build(fits, codes, lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.zeros((int(lengths.max(initial=1)), len(texts)), np.int64)
        for k, t in enumerate(texts):
            codes[: len(t), k] = [self.alphabet.get(c, 0) for c in t]
        return codes, lengths

    def distances(self, key: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Edit distance of one key to many texts: bit-parallel over the key, array-parallel over the texts."""
        one = np.uint64(1)
        peq = np.zeros(len(self.alphabet) + 1, np.uint64)
        for k, c in enumerate(key):
            peq[self.alphabet[c]] |= one << np.uint64(k)
        top = one << np.uint64(len(key) - 1)
        n = len(lengths)
        pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        score, out = np.full(n, len(key), np.int64), np.full(n, len(key), np.int64)
        for j in range(int(lengths.max(initial=0))):
            eq = peq[codes[j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += (ph & top) != 0
            score -= (mh & top) != 0
            ph = (ph << one) | one
            pv = (mh << one) | ~(xv | ph)
            mv = ph & xv
            ended = lengths == j + 1
            out[ended] = score[ended]
        return out

    def _build(self, members: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
        root: list = []
        todo = [(members, root)]
        while todo:
            some, place = todo.pop()
            if len(some):
                head, rest = some[0], some[1:]
                children: dict[int, list] = {}
                place.extend((int(head), children))
                d = self.distances(self.keys[head], codes[:, rest], lengths[rest]) if len(rest) else np.zeros(0, np.int64)
                for k in np.unique(d):
                    todo.append((rest[d == k], children.setdefault(int(k), [])))
        return root

    def search(self, texts: list[str], limits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, key, distance) of every key within each text's limit."""
        codes, lengths = self.encode(texts)
        todo = [(self.root, np.flatnonzero(lengths > 0))] if self.root else []
        while todo:
            (head, children), alive = todo.pop()
            d = self.distances(self.keys[head], codes[:, alive], lengths[alive])
            for k in np.flatnonzero(d <= limits[alive]):
                yield int(alive[k]), head, int(d[k])
            for k, child in children.items():
                near = alive[np.abs(d - k) <= limits[alive]]
                if len(near):
                    todo.append((child, near))
        for head in self.long:
            for k, t in enumerate(texts):
                if abs(len(t) - len(self.keys[head])) <= limits[k] and (d := _distance(t, self.keys[head])) <= limits[k]:
                    yield k, head, d


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


PER_WORD = 2


def limit(key: str, code: bool) -> int:
    """Edits allowed: none in codes and symbols, one for every four letters of a name, at most two words' worth."""
    return 0 if code else min(2 * PER_WORD, len(key) // 4)


def probes(words: tuple[str, ...], code: bool) -> list[str]:
    """Keys under which a query is searched: as typed, without a last plural s, and with its two words exchanged."""
    ways = [words] if code or len(words) != 2 else [words, words[::-1]]
    keys = ["".join(w) for w in ways]
    return list(dict.fromkeys(k for k in (*keys, *(k[:-1] for k in keys if not code and k.endswith("s"))) if k))


def same_words(typed: str, words: tuple[str, ...]) -> bool:
    """Whether `typed` falls into the words with at most PER_WORD edits in each, so that one shared word isn't enough."""
    if len(words) < 2:
        return not words or _distance(typed, words[0]) <= PER_WORD
    n = len(words[0])
    return any(_distance(typed[:k], words[0]) <= PER_WORD and same_words(typed[k:], words[1:]) for k in range(max(0, n - PER_WORD), min(len(typed), n + PER_WORD) + 1))


def _queries(kind: str, texts: list[str], general: frozenset[str]) -> list[tuple[tuple[str, ...], frozenset[str], bool]]:
    return [((gene_key(t),), frozenset(), True) for t in texts] if kind == "gene" else [words_of(t, general) for t in texts]


def general_words(names: DataFrame, name: str = "name", share: float = 0.01) -> frozenset[str]:
    """Words in more than `share` of the reference names; there can be no more than words per name / share of them."""
    words = names.select(F.explode(F.array_distinct(F.split(F.lower(name), r"[^\p{L}\p{M}]+"))).alias("w")).where("length(w) > 1")
    total = names.count()
    return frozenset(r.w for r in words.groupBy("w").count().where(F.col("count") > max(1, total * share)).collect()) | frozenset(REMARKS) if total else frozenset(REMARKS)


def match_names(queries: DataFrame, entries: DataFrame, kind: str, general: frozenset[str] = frozenset(), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(case_id, ref_id): for each row of `queries` (case_id, query_text) the entry meant, or 'unmatched'.

    `entries`: (ref_id, name, rank, open); names that aren't open hold their place, so that a query which means one of
    them is unmatched. Within the threshold the smallest distance wins, then agreement of the general words, then the
    lower rank, then open before closed; entries that are still equal, or a blank or null query, give 'unmatched'.
    """
    entries = entries.where("name is not null and ref_id is not null").select("ref_id", "name", F.col("rank").cast("int").alias("rank"), F.col("open").cast("boolean").alias("open")).distinct()
    n = entries.count()
    shards = max(1, -(-n // broadcast_keys))
    cases = queries.select("case_id", "query_text").where("case_id is not null")
    kind_of = cases.schema["case_id"].dataType.simpleString()

    def searcher(ref: pd.DataFrame):
        keyed: dict[str, list[tuple]] = {}
        for (words, seen, _), ref_id, rank, open_ in zip(_queries(kind, list(ref["name"]), general), ref["ref_id"], ref["rank"], ref["open"]):
            keyed.setdefault("".join(words), []).append((ref_id, seen, rank, open_, words))
        tree = Tree(k for k in keyed if k)

        def find(texts: list[str | None]) -> list[list | None]:
            """Best (score, least and greatest entry of that score, open) of each text."""
            asked = _queries(kind, [t or "" for t in texts], general)
            tries = [(q, key, code) for q, (words, _, code) in enumerate(asked) for key in probes(words, code)]
            best: list = [None] * len(texts)
            exact = {q for q, key, _ in tries if key in keyed}  # nothing is nearer, so the tree is asked for these keys alone
            tries = [x for x in tries if x[0] not in exact or x[1] in keyed]
            for t, k, d in tree.search([key for _, key, _ in tries], np.array([0 if q in exact else limit(key, code) for q, key, code in tries], np.int64)):
                q, key, _ = tries[t]
                for ref_id, seen, rank, open_, words in keyed[tree.keys[k]]:
                    score = [d, len(asked[q][1] ^ seen), int(rank), int(not open_)]
                    if best[q] is not None and score > best[q][0] or d and not same_words(key, words):
                        continue
                    if best[q] is None or score < best[q][0]:
                        best[q] = [score, ref_id, ref_id, bool(open_)]
                    else:
                        best[q][1:3] = [min(best[q][1], ref_id), max(best[q][2], ref_id)]
            return best

        return find

    def answers(pdf: pd.DataFrame, find) -> pd.DataFrame:
        distinct = list(dict.fromkeys(pdf["query_text"]))
        found = dict(zip(distinct, find(distinct)))
        rows = [found[t] for t in pdf["query_text"]]
        of = lambda k: pd.Series([r[k] if r else None for r in rows], dtype=object, index=pdf.index)
        return pd.DataFrame({"case_id": pdf["case_id"], "score": of(0), "a": of(1), "b": of(2), "open": of(3)})

    shape = f"case_id {kind_of}, score array<int>, a string, b string, open boolean"
    if shards == 1:
        sent = cases.sparkSession.sparkContext.broadcast(entries.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = None
            for pdf in batches:
                find = find or searcher(sent.value)
                yield answers(pdf, find)

        found = cases.mapInPandas(run, shape)
    else:  # every query asks every shard, in salted groups of bounded size
        salts = max(1, cases.count() // 50_000)
        asked = cases.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("salt", F.pmod(F.xxhash64("case_id"), F.lit(salts)))
        held = entries.withColumn("shard", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        found = asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInPandas(lambda q, r: answers(q, searcher(r)), shape)
    won = F.min(F.struct(F.coalesce(F.when(F.col("score").isNull(), F.lit(1)), F.lit(0)).alias("none"), "score", "a", "b", "open")).alias("w")
    last = F.max(F.when(F.col("score").isNotNull(), F.struct(F.transform("score", lambda x: -x).alias("s"), F.col("b")))).alias("l")
    best = found.groupBy("case_id").agg(won, last)
    ok = (F.col("w.none") == 0) & F.col("w.open") & (F.col("w.a") == F.col("l.b"))
    return best.select("case_id", F.when(ok, F.col("w.a")).otherwise("unmatched").alias("ref_id"))


def term_entries(ref_terms: DataFrame) -> DataFrame:
    names = F.concat(F.array(F.struct(F.col("name").alias("name"), F.lit(0).alias("rank"))), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.struct(s.alias("name"), F.lit(1).alias("rank"))))
    return ref_terms.select(F.col("id").alias("ref_id"), (~F.coalesce("obsolete", F.lit(False))).alias("open"), F.explode(names).alias("n")).select("ref_id", "n.name", "n.rank", "open")


def gene_entries(genes: DataFrame) -> DataFrame:
    lists = [F.struct(values.alias("names"), F.lit(k).alias("rank")) for k, values in enumerate((F.array("symbol"), symbol_values(F.col("prev_symbol")), symbol_values(F.col("alias_symbol"))))]
    rows = genes.select(F.col("hgnc_id").alias("ref_id"), F.coalesce(F.col("status") == "Approved", F.lit(False)).alias("open"), F.explode(F.array(*lists)).alias("l"))
    return rows.select("ref_id", F.explode("l.names").alias("name"), F.col("l.rank").alias("rank"), "open")


def map_names(queries: DataFrame, ref_terms: DataFrame, genes: DataFrame) -> DataFrame:
    """(case_id, ref_id) of every query; a query of another entity_type is unmatched. Repeats count once; where one
    case_id holds several texts the best match of them counts."""
    terms, symbols = term_entries(ref_terms), gene_entries(genes)
    of = lambda kind: queries.where(F.col("entity_type") == kind)
    rest = queries.where(~F.coalesce(F.col("entity_type").isin("cell_type", "gene"), F.lit(False)) & F.col("case_id").isNotNull()).select("case_id", F.lit("unmatched").alias("ref_id")).distinct()
    return match_names(of("cell_type"), terms, "cell_type", general_words(terms)).unionByName(match_names(of("gene"), symbols, "gene")).unionByName(rest)
