import pytest

from corrobora.operators.timestamps import normal_days, normal_moments

MOMENTS = [
    ("2024-07-16T21:38:42.749Z", None, None, "2024-07-16T21:38:42Z"),
    ("20240716T143207Z", "Asia/Kolkata", "DMY", "2024-07-16T14:32:07Z"),
    ("2024-08-12 04:01:25 EDT", "Asia/Tokyo", "YMD", "2024-08-12T08:01:25Z"),
    ("2024-03-22 00:06:37,709", "Europe/London", "DMY", "2024-03-22T00:06:37Z"),
    ("2025-01-29T04:21:19+05:30[Asia/Kolkata]", None, None, "2025-01-28T22:51:19Z"),
    ("2024-12-31 23:30:00-0800", None, None, "2025-01-01T07:30:00Z"),
    ("1729234353", None, None, "2024-10-18T06:52:33Z"),
    ("1730801988183", None, None, "2024-11-05T10:19:48Z"),
    ("08/16/2025 10:31", "America/New_York", "MDY", "2025-08-16T14:31:00Z"),
    ("08/11/2025 10:31", "Europe/Berlin", "DMY", "2025-11-08T09:31:00Z"),
    ("20/10/2024 12:31 AM", "Asia/Kolkata", "DMY", "2024-10-19T19:01:00Z"),
    ("Jun 10, 2026 12:46 pm", "America/Los_Angeles", "MDY", "2026-06-10T19:46:00Z"),
    ("Sat, 29 Jun 2024 03:27:18 -0300", None, None, "2024-06-29T06:27:18Z"),
    ("5. Dezember 2024 07:00", "Europe/Berlin", "DMY", "2024-12-05T06:00:00Z"),
    ("2024-11-03 01:30:00", "America/New_York", "MDY", "2024-11-03T05:30:00Z"),  # twice: the first
    ("2024-03-10 02:30:00", "America/New_York", "MDY", None),  # never
    ("2024-02-30 10:00:00", "UTC", "YMD", None),
    ("2023-02-29T10:00:00Z", "UTC", "YMD", None),
    ("0000-00-00 00:00:00", "UTC", "YMD", None),
    ("2024-01-01 24:00:00", "UTC", "YMD", None),
    ("2024-01-01", "UTC", "YMD", None),
    ("13/13/2024 10:00", "UTC", "DMY", None),
    ("2024-01-01 10:00:00 QQQ", "UTC", "YMD", None),
    ("2024-01-01 10:00:00", None, None, None),
    ("yesterday 14:00", "UTC", "YMD", None), ("", "UTC", "YMD", None), (None, "UTC", "YMD", None), ("x" * 100_000, "UTC", "YMD", None),
]
DAYS = [
    ("NOV  4, 2023", "2023-11-04"), ("5 juin 2024", "2024-06-05"), ("18 février 2016", "2016-02-18"), ("29-Mar-19", "2019-03-29"), ("17. Mai 2026", "2026-05-17"),
    ("02.05.2024", "2024-05-02"), ("2020-12-15 00:00:00", "2020-12-15"), ("2021-05-07T00:00:00.000", "2021-05-07"), ("20220623", "2022-06-23"), ("2010/03/08", "2010-03-08"),
    ("August 2, 2018", "2018-08-02"), ("2019", None), ("2010-01", None), ("May 2011", None), ("N/A", None), ("31.04.2024", None), (None, None), ("29 Feb 2023", None), ("29 Feb 2024", "2024-02-29"),
]


def test_moments(spark):
    rows = [(k, raw, tz, order, "kept") for k, (raw, tz, order, _) in enumerate(MOMENTS)]
    df = spark.createDataFrame(rows, "k int, raw string, tz string, `order` string, _c string")  # _c clashes with a name inside
    got = {r.k: r for r in normal_moments(df, "raw", "tz", "order").collect()}
    assert [got[k].normal_form for k in range(len(MOMENTS))] == [m[3] for m in MOMENTS]
    assert got[0]._c == "kept" and len(got) == len(MOMENTS)


def test_days(spark):
    got = {r.k: r.normal_form for r in normal_days(spark.createDataFrame([(k, raw, "old") for k, (raw, _) in enumerate(DAYS)], "k int, raw string, normal_form string"), "raw").collect()}
    assert [got[k] for k in range(len(DAYS))] == [d[1] for d in DAYS]


def test_empty(spark):
    df = spark.createDataFrame([], "raw string, tz string, `order` string")
    assert normal_moments(df, "raw", "tz", "order").count() == 0


@pytest.mark.parametrize("year", range(1890, 2110, 7))
def test_day_arithmetic(spark, year):
    import datetime as dt

    days = [dt.date(year, m, d) for m, d in ((1, 1), (2, 28), (3, 1), (12, 31))]
    got = [r.normal_form for r in normal_days(spark.createDataFrame([(f"{x:%d %b %Y}",) for x in days], "raw string"), "raw").collect()]
    assert got == [x.isoformat() for x in days]


def test_zones_by_name(spark):
    rows = [("2024-01-02T10:00[Europe/Berlin]", "America/New_York"), ("2024-01-02T10:00+05:00[Europe/Berlin]", "UTC"), ("2024-01-02T10:00Z", "No/Where"), ("2024-01-02T10:00", "No/Where"), ("2024-01-02T10:00[No/Where]", "UTC"), ("2024-01-02 10:00", "Asia/Tokyo")]
    df = spark.createDataFrame([(k, v, z, "YMD") for k, (v, z) in enumerate(rows)], "k int, v string, tz string, o string")
    got = [r.normal_form for r in normal_moments(df, "v", "tz", "o").orderBy("k").collect()]
    assert got == ["2024-01-02T09:00:00Z", "2024-01-02T05:00:00Z", "2024-01-02T10:00:00Z", None, None, "2024-01-02T01:00:00Z"]
