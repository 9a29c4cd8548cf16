"""Scalar functions over text as column expressions; the few that need Unicode tables run as Arrow UDFs."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word lists of the cue checks.
NEGATION = r"(?i)\b(no|not|none|neither|nor|without|lack(?:ed|s)? of|absence of|fail(?:ed|s)? to|cannot|non-?significant|insignificant|unaffected|insensitive|unchanged|did not|does not|do not|was not|were not|is not|are not)\b"
HEDGE = r"(?i)\b(may|might|could|suggests?|suggested|suggesting|possibl[ey]|potential(?:ly)?|likely|appears? to|hypothes\w+|speculat\w+|preliminary)\b"
NON_HUMAN = r"(?i)\b(mice|mouse|murine|rats?|xenografts?|zebrafish|drosophila|yeast|cell lines?|in vitro|organoids?)\b"
HUMAN = r"(?i)\b(patients?|humans?|individuals|subjects|participants|women|men|children|cohorts?|probands?|families|carriers|cases)\b"
#: Form of a variant description, as groups accession, version, type, rest.
HGVS = r"^((?:N[CGMRPTW]|X[MRP])_\d+)(?:\.(\d+))?:([cgmnpr])\.(\S+)$"
#: Typographic characters and their plain forms.
PLAIN_MARKS = ("‘’“”–—−", "''\"\"---")
MIN_QUOTE_WORDS, TITLE_OVERLAP = 5, 0.5


def digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def pairs(text: Column) -> Column:
    """array<struct<key, value>> of `key=value` parts between semicolons, empty unless all parts are such; the last of
    equal keys wins. Null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), ";", -1)
    both = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value")))
    fine = F.forall(parts, lambda p: (F.instr(p, "=") > 0) & (F.trim(F.substring_index(p, "=", 1)) != ""))
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda y: y["key"] == x["key"]))
    return F.when(fine, last).otherwise(F.filter(both, lambda x: F.lit(False)))


def curie_prefix(curie: Column) -> Column:
    return F.when(F.instr(curie, ":") > 0, F.substring_index(curie, ":", 1)).otherwise("")


def label_key(label: Column) -> Column:
    """Case, punctuation and a plain plural don't change a label."""
    words = F.filter(F.split(F.regexp_replace(F.lower(label), "[^0-9a-z]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)), " ")


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC, plain quotes and dashes, single blanks, none inside brackets or before punctuation."""
    marks = str.maketrans(*PLAIN_MARKS)

    def one(t):
        if t is None:
            return None
        t = " ".join(unicodedata.normalize("NFKC", t).translate(marks).split())
        return re.sub(r"(?<=[(\[])\s+|\s+(?=[)\],.;:])", "", t)

    return text.map(one)


@F.pandas_udf(StringType())
def title_key(title: pd.Series) -> pd.Series:
    """Letters and digits of a title without tags and entities, in folded case."""
    strip = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", html.unescape(re.sub(r"<[^>]*>", "", t))).casefold() if c.isalnum())
    return title.map(strip)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The one form of a JSON text: sorted members, no blanks, ASCII; null for invalid text, doubled members or NaN."""

    def unique(members):
        if len({k for k, _ in members}) < len(members):
            raise ValueError("member given twice")
        return dict(members)

    def refuse(name):
        raise ValueError(name)

    def one(t):
        try:
            return json.dumps(json.loads(t, object_pairs_hook=unique, parse_constant=refuse), sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(one)


def quote_in(quote: Column, text: Column) -> Column:
    """Whether the quote stands in the text, or would but for its last punctuation, where the text ends or goes on with
    bracketed references and punctuation. `contains` decides most rows before the pattern is tried."""
    stem = F.rtrim(quote, F.lit(" .;:"))
    tail = F.concat(F.lit(r"\Q"), F.replace(stem, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s*(?:\([^()]*\)\s*)*(?:[.;:]|$)"))
    return F.when(text.contains(quote), True).when((stem != "") & text.contains(stem), F.regexp_like(text, tail)).otherwise(False)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def plain(text: Column) -> Column:
    """The scorers' form: compatibility forms joined, plain quotes and dashes, single blanks, none just inside brackets or
    before punctuation. Texts of plain ASCII never leave the JVM."""
    t = F.translate(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_composed(text)), *PLAIN_MARKS)
    return F.regexp_replace(F.regexp_replace(clean(t), r" +(?=[)\],.;:])", ""), r"(?<=[(\[]) +", "")


def in_paper(quote: Column, paragraph: Column) -> Column:
    """Whether a quote stands in a paragraph as the scorers see it, both in plain form: as it is, or but for its last
    marks where the paragraph ends or goes on with brackets and then a mark."""
    needle, text = plain(quote), plain(paragraph)
    stem = F.rtrim(needle, F.lit(" .;:"))
    tail = F.concat(F.lit(r"\Q"), F.replace(stem, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s*(?:\([^)]*\)\s*)*(?:[.;:]|$)"))
    return F.when(needle == "", False).when(text.contains(needle), True).when((stem != "") & text.contains(stem), F.regexp_like(text, tail)).otherwise(False)


def fresh(base: Column, k: Column, taken: Column) -> Column:
    """The k-th free name (from 1) after `base`: the base itself if it isn't taken, else with -2, -3 ... and so on past all taken."""
    numbers = F.sequence(F.lit(1), k + F.size(taken))
    names = F.transform(numbers, lambda n: F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string"))))
    return F.get(F.filter(names, lambda x: ~F.array_contains(taken, x)), k - 1)


def identifier(uri: Column) -> Column:
    """pmid:, pmcid: or doi: key of a publication's address; null for any other."""
    value = F.regexp_replace(F.trim(uri), r"(?i)^https?://(?:dx\.)?doi\.org/", "doi:")
    scheme, rest = F.lower(F.substring_index(value, ":", 1)), F.trim(F.regexp_extract(value, r"^[^:]*:(.*)$", 1))
    return (
        F.when((scheme == "pmid") & rest.rlike(r"^\d+$"), F.concat(F.lit("pmid:"), F.regexp_replace(rest, r"^0+(?=\d)", "")))
        .when((scheme == "pmcid") & rest.rlike(r"(?i)^pmc\d+$"), F.concat(F.lit("pmcid:"), F.upper(rest)))
        .when((scheme == "doi") & rest.startswith("10."), F.concat(F.lit("doi:"), F.lower(rest)))
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def same_value(claimed: Column, actual: Column) -> Column:
    """Numbers agree to the decimals of the claim, other values but for case and blanks."""
    a, b = F.trim(claimed).try_cast("double"), F.trim(actual).try_cast("double")
    decimals = F.when(F.instr(claimed, ".") > 0, F.length(F.rtrim(F.regexp_extract(claimed, r"^[^.]*\.(.*)$", 1)))).otherwise(0)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.abs(a - b) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-12, F.lit(False))).otherwise(F.lower(F.trim(claimed)) == F.lower(F.trim(actual)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def sentences(text: Column, least: int = 12, most: int = 60) -> Column:
    """Sentences of `least` to `most` words: split after . ! ? before a capital."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.size(F.split(F.trim(s), r"\s+")).between(least, most))


def iso_moment(text: Column) -> Column:
    """Whether a text is an ISO 8601 moment of a possible date (a Z or offset may be missing)."""
    form = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?$")
    return form & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull() & (F.substring(text, 12, 2).try_cast("int") < 24) & (F.substring(text, 15, 2).try_cast("int") < 60)


def json_text_list(text: Column) -> Column:
    """Whether a text is a JSON list of strings that aren't blank."""
    kinds = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(kinds).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(F.from_json(text, "array<string>"), lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(False))


def has_cue(text: Column, pattern: str) -> Column:
    """Whether a text has a cue (NEGATION and the like) as whole words, whose letters and digits are those of Unicode, as
    in the reference: the engine's own word bounds know ASCII only, or count joiners as letters."""
    w = r"[\p{L}\p{N}_]"
    return text.rlike("(?iu)(?<!" + w + ")" + pattern.removeprefix(r"(?i)\b").removesuffix(r"\b").replace(r"\w", w) + "(?!" + w + ")")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def choice(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")


def paragraph_id(text: Column) -> Column:
    return F.trim(F.btrim(text, F.lit("#[]")))


def anchor(locator: Column) -> Column:
    return F.when(F.instr(locator, "#") > 0, F.substring_index(locator, "#", -1)).otherwise("")


def licence_class(licence: Column) -> Column:
    """'cc0', 'cc by' or 'other'."""
    t = F.lower(F.coalesce(licence, F.lit("")))
    tight = t.rlike(r"by-nc|by-nd|by-sa|noncommercial|non-commercial|noderiv|sharealike")
    return F.when(t.rlike(r"cc0|publicdomain/zero"), "cc0").when(t.rlike(r"cc by|creativecommons\.org/licenses/by/|creative commons attribution") & ~tight, "cc by").otherwise("other")


def without_middle_word(text: Column) -> Column:
    words = F.split(text, " ")
    k = F.floor(F.size(words) / 2).cast("int")
    return F.array_join(F.concat(F.slice(words, 1, k), F.slice(words, k + 2, F.greatest(F.size(words), F.lit(1)))), " ")


def percent(events: Column, n: Column) -> Column:
    return F.when(n > 0, F.format_string("%s/%s", events, n)).otherwise("N/A")
