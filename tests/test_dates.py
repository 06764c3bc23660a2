"""Spellings of dates."""

from datetime import datetime

from pyspark.sql import functions as F

from worklens.functions import text as T

SAME = """2024-04-03|2024/04/03|2024.04.03|2024 04 03|20240403|2024-4-3|4/3/2024|04/03/2024|04-03-2024|04.03.2024|4-3-24|04/03/24|3 April 2024|3 Apr 2024|03-Apr-2024|03-apr-24|3rd April 2024|3rd of April 2024|3. April 2024|
3/Apr/2024|3 APR, 2024|3Apr2024|April 3, 2024|Apr 3 2024|Apr. 3, 2024|APRIL 3RD, 2024|april-03-2024|Apr 03, 24|2024 Apr 3|2024-Apr-03|2024 April 3rd|Wed, 3 Apr 2024|Wednesday, April 3, 2024|Wed 2024-04-03|  2024-04-03  |3  Apr\t2024|
2024-04-03 00:00|2024-04-03 00:00:00|2024-04-03T00:00:00|2024-04-03T00:00:00.000|2024-04-03T00:00:00Z|2024-04-03 12:00 AM|April 3, 2024 12:00 a.m.|2024-04-03 05:30 +05:30|2024-04-03T05:30:00+0530|2024-04-02 19:00-05:00|3 Apr 2024 00:00 UTC"""
OTHER = {
    "25/04/2024": datetime(2024, 4, 25), "25-04-2024": datetime(2024, 4, 25), "25.4.24": datetime(2024, 4, 25), "13/12/2023": datetime(2023, 12, 13), "12/13/2023": datetime(2023, 12, 13), "2024-25-04": datetime(2024, 4, 25), "12/11/2023": datetime(2023, 12, 11),
    "29 Feb 2024": datetime(2024, 2, 29), "31 December 1999": datetime(1999, 12, 31), "1 Sept 2021": datetime(2021, 9, 1), "1 September 2021": datetime(2021, 9, 1), "5 June 2020": datetime(2020, 6, 5), "5 jul 2020": datetime(2020, 7, 5), "May 5, 2020": datetime(2020, 5, 5),
    "1/2/68": datetime(2068, 1, 2), "1/2/69": datetime(1969, 1, 2), "April 2024": datetime(2024, 4, 1), "Apr-2024": datetime(2024, 4, 1), "2024-04": datetime(2024, 4, 1), "2024/4": datetime(2024, 4, 1), "2024": datetime(2024, 1, 1),
    "2024-04-03 14:05": datetime(2024, 4, 3, 14, 5), "2024-04-03 14:05:06": datetime(2024, 4, 3, 14, 5, 6), "2024-04-03T14:05:06.25": datetime(2024, 4, 3, 14, 5, 6, 250000), "2024-04-03T14:05:06.123456789": datetime(2024, 4, 3, 14, 5, 6, 123456), "4/3/2024 2:05 PM": datetime(2024, 4, 3, 14, 5),
    "4/3/2024 12:05pm": datetime(2024, 4, 3, 12, 5), "25/04/2024 11:59:59 pm": datetime(2024, 4, 25, 23, 59, 59), "3 Apr 2024 9:30": datetime(2024, 4, 3, 9, 30), "Sat, 6 Apr 2024 23:30:00 -0100": datetime(2024, 4, 7, 0, 30), "2024-01-01T00:30+05:30": datetime(2023, 12, 31, 19, 0),
}
NONE = ["", " ", "soon", "bad", "2024-13-13", "30/02/2024", "29 Feb 2023", "31 April 2024", "32/01/2024", "0/1/2024", "April", "3 April", "12:30", "2024-04-03 25:00", "2024-04-03 10:60", "2024-04-03 13:00 pm", "2024-04-03 0:30 am", "1/2/3/4", "2024-04-03x", "x2024-04-03", "Apl 3 2024", "99999999", "1,00,000", "12345", None]


def test_spellings(spark):
    same = [s for s in SAME.replace("\n", "").split("|")]
    want = {s: datetime(2024, 4, 3) for s in same} | OTHER | {s: None for s in NONE}
    assert len(want) >= 100
    rows = spark.createDataFrame([(s,) for s in want], "s string")
    got = {r.s: r.d for r in rows.select("s", T.date(rows.s).alias("d")).collect()}
    assert {s: d for s, d in got.items() if d != want[s]} == {}
    assert dict(rows.select(T.date(rows.s).alias("d")).dtypes)["d"] == "timestamp_ntz"


def test_white_space_is_that_of_unicode(spark):
    rows = spark.range(1, 0x10000).filter("id not between 55296 and 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') c")
    rows = rows.selectExpr("id", "concat(c, 'a', c, 'b', c, c) s")
    wrong = rows.filter(T.trimmed(rows.s) != F.regexp_replace(rows.s, r"(?U)^\s+|\s+$", ""))
    assert [r.id for r in wrong.collect()] == []
