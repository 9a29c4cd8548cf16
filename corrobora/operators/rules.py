"""The rule set over evidence records as flat tables: structure first, then references, then what a profile asks for.

A record with a structural finding isn't checked further, one with a broken reference isn't compared with its profile;
either rejects all its uses. Profiles are tables, so that another domain needs no other code. Every rule is a filter over
aggregates per (record, evidence type) or per record; items are met once.

Tables: statements (record_id, statement_id, status, predicate, subject_type, object_type, scope, author), items (record_id, item_id,
source_id, kind, method, scope, author, ..), sources (record_id, source_id, frozen, observed), refs (record_id, line_id,
direction, item_id), uses (record_id, use), reviews (record_id, review_id, statement_id, use, decision, reviewer, agent),
verified (record_id, item_id). Profile: contracts (use, required, verified: arrays of types, human, independent, llm_only, match_only:
booleans) and allowed (field, value).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
#: Methods that alone don't carry a type of evidence, and statuses that end a statement.
WEAK = {"llm": "llm_extraction", "match": "string_match"}
ENDED = ("rejected", "superseded")


@dataclass(frozen=True)
class Grounder:
    """A comparison of records with a reference: `evaluate(tables)` gives (record_id, item_id, rule_id, severity), where a null rule_id
    says that the item was verified. Options (roots, keys, tables) are bound in the function; reference tables are lazy."""

    name: str
    evaluate: Callable[[Tables], DataFrame]


def grounded(tables: Tables, grounders: list[Grounder]) -> tuple[DataFrame, DataFrame]:
    """(findings of all grounders, (record_id, item_id) verified by any)."""
    rows = reduce(DataFrame.unionByName, [g.evaluate(tables) for g in grounders])
    return _finding(rows.where("rule_id is not null"), F.col("rule_id"), F.col("severity")), rows.where("rule_id is null").select("record_id", "item_id").distinct()


def _finding(rows: DataFrame, rule: Column | str, severity: Column | str, use: str | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("record_id", lit(rule).alias("rule_id"), lit(severity).alias("severity"), (F.col(use) if use else F.lit(None).cast("string")).alias("use"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _same(a: str, b: str) -> Column:
    plain = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    return plain(a) == plain(b)


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


#: Constraints of the slots, by table: a row that meets one breaks the schema. More can be passed to `structure`.
SLOTS: dict[str, dict[str, Callable[[], Column]]] = {
    "statements": {"statement_id": lambda: blank("statement_id"), "predicate": lambda: blank("predicate"), "status": lambda: ~F.coalesce(F.col("status").isin("proposed", "accepted", *ENDED), F.lit(False))},
    "items": {"item_id": lambda: blank("item_id"), "locator": lambda: blank("locator"), "kind": lambda: blank("kind"), "method": lambda: blank("method"), "scope": lambda: F.col("scope").isNull()},
    "reviews": {"decision": lambda: ~F.coalesce(F.col("decision").isin("accept", "reject", "defer"), F.lit(False)), "reviewer": lambda: blank("reviewer")},
}


def structure(tables: Tables, more: Mapping[str, Mapping[str, Callable[[], Column]]] | None = None) -> DataFrame:
    """SCHEMA: a row (record_id, slot) per slot constraint broken; `more` adds constraints, the built-in ones always hold."""
    parts = []
    for name, slots in SLOTS.items():
        every = {**slots, **(more or {}).get(name, {})}
        broken = F.filter(F.array(*[F.when(F.coalesce(test(), F.lit(True)), f"{name}.{slot}") for slot, test in every.items()]), lambda x: x.isNotNull())
        parts.append(tables[name].select("record_id", F.explode(broken).alias("slot")))
    return _union(parts)


def references(tables: Tables, contracts: DataFrame) -> DataFrame:
    """RECORD_INTEGRITY: a row (record_id, problem) per doubled id, absent source, scope with repeats, line reference
    that is doubled or leads nowhere, use that the profile hasn't or that is asked for twice, review of another statement."""
    t = tables
    say = lambda df, what: df.select("record_id", F.lit(what).alias("problem"))
    twice = lambda name, key: say(t[name].groupBy("record_id", key).agg(F.count("*").alias("n")).where("n > 1"), f"doubled {key}")
    spread = lambda name: say(t[name].where(F.size(F.array_distinct("scope")) < F.size("scope")), "doubled scope")
    known = contracts.select("use")
    return _union([
        twice("items", "item_id"), twice("sources", "source_id"), twice("uses", "use"), spread("items"), spread("statements"),
        say(t["items"].join(t["sources"].select("record_id", "source_id"), ["record_id", "source_id"], "left_anti"), "absent source"),
        say(t["refs"].groupBy("record_id", "line_id", "item_id").agg(F.count("*").alias("n")).where("n > 1"), "doubled reference"),
        say(t["refs"].join(t["items"].select("record_id", "item_id"), ["record_id", "item_id"], "left_anti"), "dangling reference"),
        say(t["uses"].join(F.broadcast(known), "use", "left_anti"), "unknown use"),
        say(t["reviews"].join(F.broadcast(known), "use", "left_anti"), "unknown review use"),
        say(t["reviews"].join(t["statements"].select("record_id", F.col("statement_id").alias("own")), "record_id").where("statement_id <> own"), "other statement"),
    ])


def supports(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(supporting items whose scope is the statement's, those whose scope isn't), a row per line and item."""
    scoped = tables["items"].join(tables["statements"].select("record_id", F.col("scope").alias("of_statement")), "record_id")
    rows = tables["refs"].where("direction = 'supports'").select("record_id", "line_id", "item_id").join(scoped.select("record_id", "item_id", "kind", "method", _same("scope", "of_statement").alias("same")), ["record_id", "item_id"])
    return rows.where("same").select("record_id", "item_id", "kind", "method").distinct(), rows.where("not same")


def on_profile(tables: Tables, contracts: DataFrame, allowed: DataFrame, verified: DataFrame) -> DataFrame:
    """Findings BEV001 to BEV013, BEV020 and BEV021. The profile's tables hold a row per use or value."""
    t, small = tables, F.broadcast(contracts)
    held, other = supports(t)
    held = held.where("kind is not null").join(verified.withColumn("ok", F.lit(True)), ["record_id", "item_id"], "left")
    # all that the rules need of the items: a row per record and type
    kinds = held.groupBy("record_id", "kind").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"), F.collect_set("method").alias("methods"))
    whole = kinds.groupBy("record_id").agg(F.collect_set("kind").alias("types"), F.array_distinct(F.flatten(F.collect_list("methods"))).alias("methods"), F.map_from_entries(F.collect_list(F.struct("kind", F.struct("ok", "methods")))).alias("by"))
    asked = t["uses"].join(small, "use").join(whole, "record_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    per_type = asked.select("record_id", "use", "types", "by", "required", "verified", "llm_only", "match_only", F.explode(F.when(F.size("required") > 0, F.transform("required", lambda k: F.struct(k.alias("kind"), F.col("by")[k]["methods"].alias("methods")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("methods"))))).alias("g"))
    only = lambda *names: (F.size("g.methods") > 0) & (F.size(F.array_except("g.methods", F.array(*[F.lit(n) for n in names]))) == 0)
    weak = F.when(only(WEAK["llm"]), F.when(~F.col("llm_only"), "BEV008")).when(only(WEAK["match"]), F.when(~F.col("match_only"), "BEV009")).when(only(*WEAK.values()), F.when(~(F.col("llm_only") & F.col("match_only")), "BEV013"))
    unproved = asked.select("record_id", "use", F.explode(F.filter("verified", lambda k: F.array_contains("types", k) & ~F.coalesce(F.col("by")[k]["ok"], F.lit(False)))).alias("kind"))
    fields = t["statements"].select("record_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("predicates", "predicate"), ("subject_types", "subject_type"), ("object_types", "object_type"))])).alias("x")).select("record_id", "x.*")
    lists = allowed.groupBy("field").agg(F.collect_set("value").alias("values"))
    line = t["refs"].where("direction = 'contradicts'").select("record_id", "line_id").distinct()
    return _union([
        _finding(t["statements"].where(F.col("status").isin(*ENDED)), "BEV001", "error"),
        _finding(t["sources"].where("observed <> '' and observed <> frozen"), "BEV002", "error"),
        _finding(fields.join(F.broadcast(lists), "field").where(~F.array_contains("values", F.col("value"))), "BEV003", "error"),
        _finding(line, "BEV004", "review"),
        _finding(other, "BEV005", "error"),
        _finding(t["statements"].join(whole.select("record_id"), "record_id", "left_anti"), "BEV006", "review"),
        _finding(asked.where(F.size(F.array_except("required", "types")) > 0), "BEV007", "error", "use"),
        _finding(per_type.withColumn("weak", weak).where("weak is not null"), F.col("weak"), F.lit("review"), "use"),
        _finding(unproved, "BEV020", "review", "use"),
        reviewed(t, contracts),
    ])


def reviewed(tables: Tables, contracts: DataFrame) -> DataFrame:
    """BEV010 to BEV012 of people's decisions, BEV021 of those of others who made none of the evidence."""
    t = tables
    authors = t["items"].select("record_id", F.col("author").alias("reviewer")).unionByName(t["statements"].select("record_id", F.col("author").alias("reviewer"))).where("reviewer is not null").distinct()
    rows = t["reviews"].join(authors.withColumn("own", F.lit(True)), ["record_id", "reviewer"], "left")
    person = F.col("agent") == "human"
    said = rows.groupBy("record_id", "use").agg(*[F.bool_or(person & (F.col("decision") == d)).alias(d) for d in ("accept", "reject", "defer")], F.collect_set(F.when(~person & F.col("own").isNull(), F.col("decision"))).alias("others"))
    no = F.lit(False)
    asked = t["uses"].join(F.broadcast(contracts), "use").join(said, ["record_id", "use"], "left")
    codes = F.array(
        F.when(F.col("human") & ~F.coalesce("accept", no), "BEV010"), F.when(F.coalesce("reject", no), "BEV011"), F.when(F.coalesce("defer", no), "BEV012"),
        F.when(F.col("independent") & ~F.coalesce(F.col("others") == F.array(F.lit("accept")), no), "BEV021"),
    )
    rows = asked.select("record_id", "use", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("rule_id"))
    return rows.select("record_id", "rule_id", F.when(F.col("rule_id").isin("BEV010", "BEV011"), "error").otherwise("review").alias("severity"), "use")


def findings(tables: Tables, contracts: DataFrame, allowed: DataFrame, grounders: list[Grounder] | None = None) -> DataFrame:
    """(record_id, rule_id, severity, use, n): all findings of all records by the stages, counted; a null use means all uses."""
    form = _finding(structure(tables), "SCHEMA", "error")
    bad = form.select("record_id").distinct()
    links = _finding(references(tables, contracts).join(bad, "record_id", "left_anti"), "RECORD_INTEGRITY", "error")
    stopped = bad.unionByName(links.select("record_id")).distinct()
    none = tables["items"].select("record_id", "item_id").limit(0)
    extra, verified = grounded(tables, grounders) if grounders else (form.limit(0), none)
    rest = on_profile(tables, contracts, allowed, verified).unionByName(extra).join(stopped, "record_id", "left_anti")
    return _union([form, links, rest]).groupBy("record_id", "rule_id", "severity", "use").agg(F.count("*").alias("n"))
