"""Text that looks the same but differs in characters, brought to one form by array operations over whole Arrow batches.

A batch becomes one array of code points. Table gathers give each code point its expansion: nothing for characters
nobody sees, an ordinary space or hyphen for their kinds, the plain letters of wide and joined ones, base and marks of
accented ones, the Latin letter for a look-alike of another script. Marks are then put in canonical order and composed
with their letters, all without a call per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import cut

#: Letters of other scripts that look like Latin ones, by the Latin letter.
LOOKALIKES = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "р", "q": "ԛ",
    "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ",
    "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ",
    "Y": "ΥҮ", "Z": "Ζ",
}
#: Hyphens that look like the ASCII one (dashes and the minus sign are longer and stay).
HYPHENS = "‐‑﹣－"
#: Characters nobody sees that are not of the Unicode class for them (Cf): joiners and selectors.
UNSEEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
SIZE = 0x110000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, ...]:
    """(start, length, pool): the expansion of each code point; ccc: combining class; pair keys and what they compose to."""
    latin = {ord(c): ord(k) for k, v in LOOKALIKES.items() for c in v}
    unseen = set(UNSEEN)

    def expand(cp: int) -> list[int]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if cp in unseen or kind == "Cf":
            return []
        if kind == "Zs":
            return [32]
        if ch in HYPHENS:
            return [45]
        if cp in latin:
            return [latin[cp]]
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            return [cp]
        if parts[0][0] == "<":
            joined = 0xFB00 <= cp <= 0xFB4F or 0x0132 <= cp <= 0x0133 or 0x01C4 <= cp <= 0x01CC or 0x01F1 <= cp <= 0x01F3
            if parts[0] not in ("<wide>", "<narrow>") and not (parts[0] == "<compat>" and joined):
                return [cp]
            parts = parts[1:]
        return [x for p in parts for x in expand(int(p, 16))]

    start, length, pool = np.arange(SIZE, dtype=np.int64), np.ones(SIZE, np.int64), [np.arange(SIZE, dtype=np.uint32)]
    ccc = np.zeros(SIZE, np.uint8)
    at, pairs = SIZE, set()
    for cp in [*range(0xA0, 0x30000), *range(0xE0000, 0xE0200)]:
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7B0 or 0xD800 <= cp < 0xF900:  # ideographs and Hangul stay as they are
            continue
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        to = expand(cp)
        if to != [cp]:
            start[cp], length[cp] = at, len(to)
            pool.append(np.array(to, np.uint32))
            at += len(to)
        d = unicodedata.decomposition(ch).split()
        if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            a, b = expand(int(d[0], 16)), expand(int(d[1], 16))
            if len(b) == 1:
                a = [int(x) for x in map(ord, unicodedata.normalize("NFC", "".join(map(chr, a))))]
                if len(a) == 1:
                    pairs.add(a[0] << 21 | b[0])
    # only what composes after the look-alikes are Latin letters; the letter composed is then that of the Latin base
    joined = {key: unicodedata.normalize("NFC", chr(key >> 21) + chr(key & 0x1FFFFF)) for key in pairs}
    pairs = {key: ord(c) for key, c in joined.items() if len(c) == 1}
    keys = np.array(sorted(pairs), np.int64)
    return start, length, np.concatenate(pool), ccc, keys, np.array([pairs[int(k)] for k in keys], np.uint32)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array and the row borders in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets - offsets[0]]


def _strings(points: np.ndarray, borders: np.ndarray, valid: pa.Array) -> pa.Array:
    raw = points.tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[borders]
    out = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw))
    return pa.compute.if_else(valid, out, None).cast(pa.string()) if out.nbytes < 2**31 else pa.compute.if_else(valid, out, None)


def one_form(column: pa.Array) -> pa.Array:
    """The common form of every text of a batch; null stays null."""
    start, length, pool, ccc, keys, composed = tables()
    points, borders = _code_points(column)
    valid = column.is_valid()
    if points.size and points.max() >= 0x7F:
        n = length[points]
        ends = np.cumsum(n)
        total = int(ends[-1])
        source = np.repeat(start[points] - (ends - n), n) + np.arange(total)
        borders = np.concatenate(([0], ends))[borders]
        points = pool[source]
        marks = ccc[points]
        first = np.zeros(total + 1, bool)
        first[borders] = True
        first = first[:total]
        if marks.any():
            group = np.cumsum((marks == 0) | first)  # a letter and the marks after it
            order = np.lexsort((marks, group))
            points, marks = points[order], marks[order]
            starts_row = first  # borders stay, as sorting never leaves a group
            while True:  # each letter takes the first mark it composes with that no mark of its class stands before
                here = np.flatnonzero(marks)
                letter = np.maximum.accumulate(np.where((marks == 0) | starts_row, np.arange(len(points)), 0))[here]
                free = (here > letter) & (marks[letter] == 0)
                free &= (here - 1 == letter) | (marks[here - 1] != marks[here])
                here, letter = here[free], letter[free]
                key = points[letter].astype(np.int64) << 21 | points[here]
                spot = np.searchsorted(keys, key).clip(max=len(keys) - 1)
                hit = np.flatnonzero(keys[spot] == key)
                if not len(hit):
                    break
                hit = hit[np.unique(letter[hit], return_index=True)[1]]
                points[letter[hit]] = composed[spot[hit]]
                keep = np.ones(len(points), bool)
                keep[here[hit]] = False
                borders = np.concatenate(([0], np.cumsum(keep)))[borders]
                points, marks, starts_row = points[keep], marks[keep], starts_row[keep]
    return _strings(points, borders, valid)


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """Adds `form`, the form under which texts that look the same are equal. Null stays null, a text of unseen
    characters alone gives ''. A column named `form` is replaced. Long texts take memory in proportion to their batch only."""
    kept = [c for c in df.columns if c != form or c == text]
    place = kept.index(text)
    kinds = T.StructType([*df.select(*kept).schema.fields, T.StructField(form, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, one_form(batch.column(place))], names=[*batch.schema.names, form])

    return df.select(*kept).mapInArrow(run, kinds)


def same_looking_pairs(df: DataFrame, src: str, row_id: str, text: str) -> DataFrame:
    """(src, id_1, id_2), id_1 < id_2: rows of one source whose texts look the same but differ in characters.

    Rows with a null id or text and texts without a visible character make no pairs; repeats of a row count once. Only
    forms with two or more texts go on. Distinct texts are paired first and ids joined to them after, so that a text
    held by a third of all rows is never compared with itself; its join is left to adaptive skew splitting.
    """
    rows = df.select(F.col(src).alias("src"), F.col(row_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    # one pass over the texts, of which only ids and digests are kept
    keyed = with_form(rows, "text").where("form <> ''").select("src", "id", F.unhex(F.md5("form")).alias("f"), F.unhex(F.md5("text")).alias("t"))
    keyed = cut(keyed)
    several = keyed.groupBy("src", "f").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("src", "f")
    kept = cut(keyed.join(several, ["src", "f"], "left_semi").distinct())
    texts = kept.select("src", "f", "t").distinct()
    pairs = texts.alias("x").join(texts.alias("y"), ["src", "f"]).where("x.t < y.t").select("src", "f", F.col("x.t").alias("t"), F.col("y.t").alias("t2"))
    left = pairs.join(kept, ["src", "f", "t"]).select("src", "f", F.col("t2").alias("t"), F.col("id").alias("i"))
    both = left.join(kept, ["src", "f", "t"]).where("i <> id")
    return both.select("src", F.least("i", "id").alias("id_1"), F.greatest("i", "id").alias("id_2")).distinct()
