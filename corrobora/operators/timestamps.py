"""Timestamps of mixed format and zone to one UTC form, on the JVM alone.

All formats form one alternation with named groups. One regexp_replace rewrites a value to its components, which are
checked against the calendar and turned into seconds through integer day arithmetic; only a site's local time needs
the zone database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in English, German and French, by number. Their first three letters tell them apart where unique.
MONTHS = {
    1: "JANUARY JAN JANUAR JANVIER JÄNNER",
    2: "FEBRUARY FEB FEBRUAR FÉVRIER FEVRIER FÉV",
    3: "MARCH MAR MÄRZ MAERZ MARS MRZ",
    4: "APRIL APR AVRIL AVR",
    5: "MAY MAI",
    6: "JUNE JUN JUNI JUIN",
    7: "JULY JUL JULI JUILLET JUIL",
    8: "AUGUST AUG AOÛT AOUT",
    9: "SEPTEMBER SEP SEPT SEPTEMBRE",
    10: "OCTOBER OCT OKTOBER OKT OCTOBRE",
    11: "NOVEMBER NOV NOVEMBRE",
    12: "DECEMBER DEC DEZEMBER DEZ DÉCEMBRE DECEMBRE DÉC",
}
#: Zone abbreviations as minutes from UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EAT": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "AWST": 480,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "BRT": -180, "BRST": -120,
}

_DATES = (
    r"(?<y1>\d{4})[-/.](?<m1>\d{1,2})[-/.](?<d1>\d{1,2})",
    r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})(?=$|[T ]|\d{6}\b)",
    r"(?<a3>\d{1,2})[/-](?<b3>\d{1,2})[/-](?<y3>\d{4})",
    r"(?<d4>\d{1,2})\.(?<m4>\d{1,2})\.(?<y4>\d{4})",
    r"(?:\p{L}{2,9}\.?,? )?(?<d5>\d{1,2})(?:ST|ND|RD|TH|ER)?\.?[ -]{0,2}(?<n5>\p{L}{3,9})\.?,?[ -](?<y5>\d{4}|\d{2})(?!\d)",
    r"(?:\p{L}{3,9}\.?, )?(?<n6>\p{L}{3,9})\.? (?<d6>\d{1,2})(?:ST|ND|RD|TH)?,? (?<y6>\d{4})",
)
_TIME = r"(?<h>\d{1,2}):?(?<i>\d{2})(?::?(?<s>\d{2})(?:[.,]\d{1,9})?)? ?(?<p>[AP]\.?M\.?)? ?(?<z>[+-]\d{1,2}:?\d{2}|[+-]\d{2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5})?(?:\[[\w/+-]+\])?"
PATTERN = r"^(?:(?<e>\d{10}|\d{13}|\d{16})|(?:" + "|".join(_DATES) + r")(?:(?:,? AT |,? ?T|, | )?" + _TIME + r")?)$"
_PARTS = ("${e}", "${y1}${y2}${y3}${y4}${y5}${y6}", "${m1}${m2}${m4}", "${d1}${d2}${d4}${d5}${d6}", "${n5}${n6}", "${a3}", "${b3}", "${h}", "${i}", "${s}", "${p}", "${z}")
_MARK = "\x01"


def _components(raw: Column) -> Column:
    text = F.upper(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")))
    return F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(_MARK + _MARK.join(_PARTS))), _MARK)


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that the optimizer keeps each computed once instead of copying it into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a proleptic Gregorian date."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    of_era = yy - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def with_parts(df: DataFrame, raw: str, order: str | None) -> DataFrame:
    """Adds _days (days since 1970, null unless the value names a full possible date), _secs (seconds of the day, null
    without a time), _zone (the zone as written, '' if none) and _epoch (seconds, where the value is a Unix time).
    `order`: column of 'DMY', 'MDY' or 'YMD' for dates of two leading short numbers; where it is null or 'YMD', day and
    month are taken only if one of them can't be a month."""
    names = F.create_map(*[F.lit(x) for k, words in MONTHS.items() for w in words.split() for x in (w, k)])
    c = F.col("_c")
    df = step(df, _c=_components(F.col(raw)))
    df = step(df, _read=F.size("_c") == len(_PARTS) + 1, _a=F.try_element_at(c, F.lit(7)).try_cast("int"), _b=F.try_element_at(c, F.lit(8)).try_cast("int"))
    a, b = F.col("_a"), F.col("_b")
    by = F.coalesce(F.col(order) if order else F.lit(None).cast("string"), F.lit("?"))
    month_first = F.when(by == "MDY", True).when(by == "DMY", False).when(a > 12, False).when(b > 12, True)
    at = lambda k: F.try_element_at(c, F.lit(k + 1))
    num = lambda k: at(k).try_cast("int")
    text = lambda k: F.coalesce(at(k), F.lit(""))
    df = step(
        df,
        _y=F.when(F.length(at(2)) == 2, num(2) + F.when(num(2) < 70, 2000).otherwise(1900)).otherwise(num(2)),
        _m=F.when(a.isNotNull(), F.when(month_first, a).when(~month_first, b)).when(text(5) != "", names[at(5)]).otherwise(num(3)),
        _d=F.when(a.isNotNull(), F.when(month_first, b).when(~month_first, a)).otherwise(num(4)),
        _h=num(8), _i=num(9), _s=F.coalesce(num(10), F.lit(0)), _p=text(11), _zone=text(12), _timed=F.col("_read") & (text(8) != ""),
        _e=F.when(F.col("_read"), at(1).try_cast("long")), _digits=F.length(text(1)),
    )
    y, m, d, h = F.col("_y"), F.col("_m"), F.col("_d"), F.col("_h")
    ok = F.col("_read") & m.between(1, 12) & (d >= 1) & (d <= _month_length(y, m)) & y.between(1, 9999)
    hour = F.when(F.col("_p") != "", F.when(h.between(1, 12), h % 12 + F.when(F.col("_p").startswith("P"), 12).otherwise(0))).otherwise(h)
    fine = hour.between(0, 23) & F.col("_i").between(0, 59) & F.col("_s").between(0, 59)
    e, digits = F.col("_e"), F.col("_digits")
    return step(
        df,
        _days=F.when(ok, _days(y, m, d)),
        _secs=F.when(fine, (hour * 3600 + F.col("_i") * 60 + F.col("_s")).cast("long")),
        _epoch=F.when(digits == 10, e).when(digits == 13, F.floor(e / 1000)).when(digits == 16, F.floor(e / 1000000)),
    )


def _offset_minutes(zone: Column) -> Column:
    fixed = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v)])
    hh = F.regexp_extract(zone, r"([+-])(\d{1,2}):?(\d{2})?$", 2).try_cast("int")
    mm = F.coalesce(F.regexp_extract(zone, r"([+-])(\d{1,2}):?(\d{2})?$", 3).try_cast("int"), F.lit(0))
    sign = F.when(zone.contains("-"), -1).otherwise(1)
    return F.coalesce(fixed[zone], F.when((hh <= 14) & (mm <= 59), sign * (hh * 60 + mm)))


def _iso(seconds: Column) -> Column:
    day = F.floor(seconds / 86400)
    rest = (seconds - day * 86400).cast("int")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def _packed(df: DataFrame, **columns: str | None) -> DataFrame:
    """The rows as `_row`, but for a column normal_form, and the columns in question beside them, so that no other
    column's name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "normal_form"]).alias("_row")
    return df.select(row, *[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f"_{k}") for k, c in columns.items()])


def _known_zone(df: DataFrame, name: Column) -> Column:
    """The name, or null if the zone database hasn't it (the engine would end the job over such a name)."""
    jvm = df.sparkSession._jvm
    names = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")
    return F.when(name.isin(names), name)


def normal_moments(df: DataFrame, raw: str, tz: str, order: str) -> DataFrame:
    """Adds `normal_form`: the moment of `raw` as YYYY-MM-DDTHH:MM:SSZ, or null where it names none.

    A zone in brackets behind the time ([Europe/Berlin]) is its zone if it has no other. Null, blank, unreadable and
    impossible values, values without a time of day, unknown zone names, local times of an
    unknown site (`tz` null or no zone) and local times skipped by a clock change give null. A local time that occurs twice means
    its first occurrence; fractions are dropped. The rows and the other columns stay as they are, but for
    a column normal_form, which is replaced.
    """
    df = with_parts(_packed(df, raw=raw, tz=tz, order=order), "_raw", "_order")
    df = step(df, _local=F.col("_days") * 86400 + F.col("_secs"), _offset=F.when(F.col("_zone") != "", _offset_minutes(F.col("_zone"))))
    local = F.col("_local")
    named = F.when(F.col("_raw").contains("["), F.regexp_extract("_raw", r"\[([\w/+-]+)\]\s*$", 1)).otherwise("")
    df = step(df.withColumnRenamed("_tz", "_site"), _tz=_known_zone(df, F.when(named != "", named).otherwise(F.col("_site"))))
    df = step(df, _utc=F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), F.col("_tz"))))
    back = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds("_utc"), F.col("_tz")))
    df = step(df, _at=F.coalesce("_epoch", F.when(F.col("_timed"), F.when(F.col("_zone") != "", local - F.col("_offset") * 60).when(back == local, F.col("_utc")))))
    return df.select("_row.*", _iso(F.col("_at")).alias("normal_form"))


def normal_days(df: DataFrame, raw: str, order: str | None = None) -> DataFrame:
    """Adds `normal_form`: the day of `raw` as YYYY-MM-DD, or null where it names no full, possible day. A time of day
    written with it is ignored if it is possible, whatever its zone."""
    df = with_parts(_packed(df, raw=raw, order=order), "_raw", "_order")
    ok = ~F.col("_timed") | F.col("_secs").isNotNull()
    return df.withColumn("normal_form", F.when(ok, F.date_from_unix_date(F.col("_days").cast("int")).cast("string"))).select("_row.*", "normal_form")
