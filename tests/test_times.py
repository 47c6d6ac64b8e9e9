from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tessera.functions import times

#: Said on a Sunday, the last of March in a leap year.
SAID = D(2024, 3, 31, 15, 30)
CASES = [
    ("seen yesterday", D(2024, 3, 30), D(2024, 3, 31)),
    ("Tomorrow then", D(2024, 4, 1), D(2024, 4, 2)),
    ("the day before yesterday it rained", D(2024, 3, 29), D(2024, 3, 30)),
    ("3 days ago", D(2024, 3, 28), D(2024, 3, 29)),
    ("two weeks ago", D(2024, 3, 17), D(2024, 3, 18)),
    ("twenty-one days ago", D(2024, 3, 10), D(2024, 3, 11)),
    ("1,000 days ago", D(2021, 7, 5), D(2021, 7, 6)),
    ("one month ago", D(2024, 2, 29), D(2024, 3, 1)),
    ("in 2 years we go", D(2026, 3, 31), D(2026, 4, 1)),
    ("2000 years ago", None, None),
    ("99999 months ago", None, None),
    ("last week", D(2024, 3, 18), D(2024, 3, 25)),
    ("NEXT week", D(2024, 4, 1), D(2024, 4, 8)),
    ("this week", D(2024, 3, 25), D(2024, 4, 1)),
    ("last Monday", D(2024, 3, 25), D(2024, 3, 26)),
    ("next sunday", D(2024, 4, 7), D(2024, 4, 8)),
    ("last sunday", D(2024, 3, 24), D(2024, 3, 25)),
    ("this friday", D(2024, 3, 29), D(2024, 3, 30)),
    ("on 2024-02-29", D(2024, 2, 29), D(2024, 3, 1)),
    ("on 2023-02-29", None, None),
    ("at 2024-01-02 03:04", D(2024, 1, 2, 3, 4), None),
    ("at 2024-01-02T03:04:05+02:00", D(2024, 1, 2, 1, 4, 5), None),
    ("on 2024/1/2", D(2024, 1, 2), D(2024, 1, 3)),
    ("2024年1月2日", D(2024, 1, 2), D(2024, 1, 3)),
    ("on March 5th, 2023", D(2023, 3, 5), D(2023, 3, 6)),
    ("Sept. 9 it was", D(2024, 9, 9), D(2024, 9, 10)),
    ("12/25/2023", D(2023, 12, 25), D(2023, 12, 26)),
    ("三天前", D(2024, 3, 28), D(2024, 3, 29)),
    ("十二天后", D(2024, 4, 12), D(2024, 4, 13)),
    ("两个月前", D(2024, 1, 31), D(2024, 2, 1)),
    ("昨天", D(2024, 3, 30), D(2024, 3, 31)),
    ("上周三", D(2024, 3, 27), D(2024, 3, 28)),
    ("下周", D(2024, 4, 1), D(2024, 4, 8)),
    ("from 2024-01-01 to 2024-01-05", D(2024, 1, 1), D(2024, 1, 6)),
    ("between May 1, 2023 and May 3, 2023", D(2023, 5, 1), D(2023, 5, 4)),
    ("2024-01-01 – 2024-01-05", D(2024, 1, 1), D(2024, 1, 6)),
    ("from 2024-01-05 to 2024-01-01", None, None),
    ("2024-01-01 and 2024-01-05", None, None),
    ("从昨天到今天", D(2024, 3, 30), D(2024, 4, 1)),
    ("it was 2024-13-45, or yesterday", D(2024, 3, 30), D(2024, 3, 31)),
    ("yesterdays and 3 daysago", None, None),
    ("soon", None, None),
    ("", None, None),
    (None, None, None),
]


def test_expressions(spark):
    df = spark.createDataFrame([(i, c[0], SAID) for i, c in enumerate(CASES)], "i int, text string, said timestamp_ntz")
    got = {r.i: (r.o.start, r.o.end) if r.o else (None, None) for r in df.select("i", times.occurrence(F.col("text"), F.col("said")).alias("o")).collect()}
    wrong = {CASES[i][0]: (g, CASES[i][1:]) for i, g in got.items() if g != CASES[i][1:]}
    assert not wrong


@pytest.mark.parametrize(("value", "day"), [("on 2024-01-05", 5), ("2024-01-09", None), ("2024-01-01 and 2024-01-05", None), (None, None)])
def test_a_fact_names_one_of_several(spark, value, day):
    df = spark.createDataFrame([("2024-01-01 and 2024-01-05", SAID, value)], "text string, said timestamp_ntz, value string")
    o = df.select(times.occurrence(F.col("text"), F.col("said"), F.col("value")).alias("o")).first().o
    assert (o and o.start) == (day and D(2024, 1, day))


def test_without_a_time_only_absolute_dates_count(spark):
    df = spark.createDataFrame([(t, None) for t in ("yesterday", "2024-01-02", "March 5", "3 days ago and 2023-01-01")], "text string, said timestamp_ntz")
    assert [r.o and r.o.start for r in df.select(times.occurrence(F.col("text"), F.col("said")).alias("o")).collect()] == [None, D(2024, 1, 2), None, D(2023, 1, 1)]
