"""Fields that hold several values, split into rows with their places, by SQL array folds on the JVM.

Quoted spans become the odd pieces of a split and stay literal; even pieces are split on delimiters; a fold puts the
pieces together again, so that a delimiter inside quotes never divides a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTE, _CUT = "\x01", "\x02"
#: Delimiters: semicolons (also wide ones), commas, bars and line ends, with any blanks around; a slash only between blanks.
PLAIN = r"\s*[;；,，|\n]\s*|\s+/\s+"
#: In locators a delimiter counts only before a key, an anchor, a quoted value or the end; blanks alone divide anchors.
LOCATOR = r"\s*(?:[;；,，|/\n]\s*)+(?=$|#|[\w.-]+\s*=)|\s+(?=#)|\s*\n\s*(?=[\w.-]+\s*=)"
_QUOTED = r"\"([^\"]*)\"|(?<![\w])'([^']*)'(?![\w])"


def split_packed(text: Column, delimiter: str = PLAIN, unwrap: Column | None = None) -> Column:
    """array<string> of the values in `text`, without quote marks and surrounding blanks; empty values are left out.

    Null and blank texts give an empty array. A JSON or Python list is read as its members, also when the list itself is
    quoted as a string. `unwrap`: condition under which a field that is one quoted string is taken as its content.
    """
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ 　\t]", " "))
    # a list written as a JSON string: the outer quotes and the escapes go
    s = F.when(s.rlike(r'^"\s*\[') & s.rlike(r'\]\s*"$'), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r'^"\s*|\s*"$', ""), r'\\(["\\])', "$1"), '""', '"')).otherwise(s)
    s = F.when(s.rlike(r"^\[") & s.rlike(r"\]$"), F.regexp_replace(s, r"^\[|\]$", "")).otherwise(s)
    if unwrap is not None:
        s = F.when(unwrap & s.rlike("^\"[^\"]*\"$|^'[^']*'$"), F.regexp_replace(s, "^[\"']|[\"']$", "")).otherwise(s)
    pieces = F.split(F.regexp_replace(s, _QUOTED, f"{_QUOTE}$1$2{_QUOTE}"), _QUOTE, -1)
    marked = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, delimiter, _CUT)).otherwise(p))
    folded = F.aggregate(marked, F.lit(""), lambda acc, p: F.concat(acc, p))
    return F.filter(F.transform(F.split(folded, _CUT, -1), lambda v: F.regexp_replace(v, r"^[\s]+|[\s]+$", "")), lambda v: v != "")


def packed_rows(df: DataFrame, row_id: str, values: Column, src: str, least: int = 2) -> DataFrame:
    """One row (src, row_id, pos, item) per value of fields with at least `least` values. Repeated input rows count once;
    rows with a null id are left out. No shuffle but the last one, on the whole output row."""
    item = F.regexp_replace(F.col("item"), r"^([^=]*?)\s*=\s*", "$1=")
    return (
        df.select(F.col(row_id).alias("row_id"), values.alias("_v"))
        .where(F.col("row_id").isNotNull() & (F.size("_v") >= least))
        .select(F.lit(src).alias("src"), "row_id", F.posexplode("_v").alias("pos", "item"))
        .select("src", "row_id", "pos", item.alias("item"))
        .distinct()
    )


def locator_values(locator: Column) -> Column:
    """Values of a locator of key=value pairs and anchors. Any other locator, also one that holds more than these, is one
    value, so that nothing of it is lost."""
    s = split_packed(locator, LOCATOR)
    fine = F.forall(s, lambda v: v.rlike(r"^#") | v.rlike(r"^[\w.-]+\s*="))
    return F.when(fine, s).otherwise(F.array(F.trim(locator)))


def symbol_values(symbols: Column) -> Column:
    """Values of a symbol list; a list quoted as a whole is still a list, as symbols hold no delimiters."""
    return split_packed(symbols, PLAIN, F.lit(True))


def reference_values(refs: Column) -> Column:
    return split_packed(refs, PLAIN)
