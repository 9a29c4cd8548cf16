"""Deeply nested JSON to related flat tables.

Each record is parsed once (as a whole, not as a stream) into (path, ordinals, value) triples, which carry the array
they repeat under; triples of one array place are pivoted into one row, so that each array gives a table whose rows keep
the ordinals of all their ancestors as parent links.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _refuse(name: str) -> None:
    raise ValueError(name)


def _parse(text: str):
    return json.loads(text, parse_constant=_refuse)


def triples(payload: str | None, lists: frozenset[str], wrappers: frozenset[str], wrapped: str | None = None, never: frozenset[str] = frozenset()) -> Iterator[tuple[str, list[int], str | None, str | None, str]]:
    """(path, ordinals, value, ancestor, wrapper) of every leaf of one JSON text, in reading order; nothing for text that isn't valid JSON.

    Paths join member names with dots; a list adds its place to the ordinals and nothing to the path. A lone value of a
    member named in `lists` counts as a list of one. Objects written inside a string are read as such, lists if the member is named in `lists`.
    Objects under a top-level member named in `wrappers`, or that hold the member `wrapped` themselves (unless named in
    `never`), count as if they weren't wrapped. Empty lists and objects give
    no triple, null leaves give a null value. The ancestor is the path of the innermost list around the leaf, null where
    none is; the wrapper names the members left out as such. Records of any depth that the parser
    takes (thousands) count; of a member given twice the last counts, as everywhere in JSON.
    """
    if payload is None:
        return
    try:
        top = _parse(payload)
    except (ValueError, RecursionError):
        return
    out: list[tuple[str, list[int], str | None, str | None, str]] = []
    stack = [(top, "", [], False, None, "")]
    while stack:
        node, path, at, listed, above, wrapper = stack.pop()
        name = path.rpartition(".")[2]
        if isinstance(node, str) and (node[:1] == "{" and node[-1:] == "}" or name in lists and node[:1] == "[" and node[-1:] == "]"):
            try:
                node = _parse(node)
            except (ValueError, RecursionError):
                pass
        if isinstance(node, list):
            stack.extend((x, path, [*at, i], True, path, wrapper) for i, x in reversed(list(enumerate(node))))
            continue
        if name in lists and not listed and node is not None:
            at, above = [*at, 0], path
        if isinstance(node, dict):
            for k, v in reversed(list(node.items())):
                inside = path == "" and isinstance(v, dict) and (k in wrappers or wrapped is not None and wrapped in v and k not in never)
                stack.append((v, "" if inside else f"{path}.{k}" if path else k, at, False, above, f"{wrapper}.{k}" if inside else wrapper))
        else:
            out.append((path, at, node if isinstance(node, str) or node is None else json.dumps(node), above, wrapper))
    yield from out


def json_triples(df: DataFrame, id_col: str, payload_col: str, lists: Iterable[str] = (), wrappers: Iterable[str] = (), paths: Iterable[str] | None = None, wrapped: str | None = None, never: Iterable[str] = ()) -> DataFrame:
    """(id, record, path, ordinals, value, ancestor, wrapper) of every record, or only of the paths given; `record` is a
    hash of the payload, as an id may have several. Rows with a null id or payload, or a
    payload that isn't valid JSON, give no rows. The parse is one narrow Arrow pass; nothing is shuffled."""
    barred = frozenset(never)
    many, wrap, only = frozenset(lists), frozenset(wrappers), frozenset(paths) if paths is not None else None
    src = df.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"), F.xxhash64(payload_col).alias("record")).where("id is not null and payload is not null")
    kind = src.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = ([], [], [], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                for path, *leaf in triples(text, many, wrap, wrapped, barred):
                    if only is None or path in only:
                        for col, x in zip(cols, (row, path, *leaf)):
                            col.append(x)
            rows = pa.array(cols[0], pa.int64())
            rest = [pa.array(col, pa.list_(pa.int32()) if k == 1 else pa.string()) for k, col in enumerate(cols[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), *rest], names=["id", "record", "path", "ordinals", "value", "ancestor", "wrapper"])

    return src.mapInArrow(read, f"id {kind}, record long, path string, ordinals array<int>, value string, ancestor string, wrapper string")


def pivoted(triple_df: DataFrame, members: dict[str, str]) -> DataFrame:
    """The tables of all ancestors with one of the members (output column by path): a row per place, keyed by id, record,
    wrapper, ancestor and ordinals, a column per name in `members`. A repeated record counts once; different payloads of
    one id stay apart."""
    columns = {c: [p for p in members if members[p] == c] for c in members.values()}
    here = triple_df.where(F.col("path").isin(list(members)))
    return here.groupBy("id", "record", "wrapper", "ancestor", "ordinals").agg(*[F.max(F.when(F.col("path").isin(paths), F.col("value"))).alias(c) for c, paths in columns.items()])


def flat_table(triple_df: DataFrame, ancestor: str, members: dict[str, str], depth: int) -> DataFrame:
    """The table of one repeated ancestor: a row per place, with the id and `pos_0` .. of the enclosing arrays, a column
    per member path that repeats under no list below it."""
    rows = pivoted(triple_df.where(F.col("ancestor") == ancestor), members)
    return rows.select("id", *[F.get("ordinals", F.lit(k)).alias(f"pos_{k}") for k in range(depth)], *dict.fromkeys(members.values()), "ancestor")


LISTS, WRAPPERS = ("attempts", "citations", "codes"), ("summary",)
WRAPPED, NEVER = "pooled", ("results", "attempts", "citations", "bioevidence")
#: The tables of an episode: column by member path, with and without attempts.
CITATIONS = {f"{a}citations.{m}": m.replace(".", "_") for a in ("attempts.", "") for m in ("pmid", "title", "category", "quote.text", "quote.paragraph")}
CODES = {f"{a}bioevidence.codes{m}": c for a in ("attempts.", "") for m, c in (("", "code"), (".rule_id", "rule_id"), (".severity", "severity"))}
POOLED = {f"pooled.{a}.{m}": f"{a}_{m}" for a in ("accepted_beyond_civic", "admitted_after_feedback") for m in ("events", "n", "rate", "wilson_95")}
#: Columns of which `episode_fields` is made, and the fields they give.
FIELDS = {"pmid": "citations.pmid", "code": "bioevidence.codes", "rule_id": "bioevidence.codes", "accepted_beyond_civic_n": "pooled.accepted_beyond_civic.n"}


def episode_triples(episodes: DataFrame, members: dict[str, str]) -> DataFrame:
    return json_triples(episodes, "episode_id", "payload", LISTS, WRAPPERS, members, WRAPPED, NEVER)


def episode_table(episodes: DataFrame, members: dict[str, str]) -> DataFrame:
    """(id, ancestor, ordinals, attempt, place, members): one row per place of an episode that holds one of the members.
    attempt is null outside attempts; place is that in the list below, null where there is none. A member that is a list
    itself gives rows of that ancestor."""
    rows = pivoted(episode_triples(episodes, members), members)
    tried = F.coalesce(F.col("ancestor").startswith("attempts"), F.lit(False))
    place = F.get("ordinals", F.when(tried, 1).otherwise(0))
    return rows.select("id", "ancestor", "ordinals", F.when(tried, F.get("ordinals", F.lit(0))).alias("attempt"), place.alias("place"), *dict.fromkeys(members.values())).distinct()


def episode_fields(episodes: DataFrame) -> DataFrame:
    """(episode_id, field_path, outer_pos, pos, item): one row per citation, code and pooled count of the episodes, read
    off the places of their tables."""
    members = {p: c for p, c in (CITATIONS | CODES | POOLED).items() if c in FIELDS}
    rows = pivoted(episode_triples(episodes, members).where("value is not null"), members)
    tried = F.coalesce(F.col("ancestor").startswith("attempts"), F.lit(False))
    cells = F.array(*[F.struct(F.lit(f).alias("field_path"), (F.regexp_replace(c, "[^0-9]", "") if c == "pmid" else F.trim(c)).alias("item")) for c, f in FIELDS.items()])
    n, pooled = F.size("ordinals"), F.col("field_path").startswith("pooled.")
    return (
        rows.select("id", "ordinals", tried.alias("tried"), F.inline(cells))
        .where("item <> ''")
        .select(
            F.col("id").alias("episode_id"),
            "field_path",
            F.when(F.col("tried") & (n > 0), F.get("ordinals", F.lit(0))).otherwise(0).alias("outer_pos"),
            F.when(~pooled & (n > 0), F.get("ordinals", n - 1)).otherwise(0).alias("pos"),
            "item",
        )
        .distinct()
    )
