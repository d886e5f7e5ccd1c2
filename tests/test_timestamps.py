from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from threshline.functions.timestamps import DAY_US, local_to_utc, with_instant
from threshline.operators.instants import instants


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 10**6 + micro


CASES = [
    ("2023-01-01 02:09:58 UTC", us(2023, 1, 1, 2, 9, 58)),
    (" 2023-01-08t13:14:17z\t", us(2023, 1, 8, 13, 14, 17)),
    ("2023-01-03T03:15:59.420019163Z", us(2023, 1, 3, 3, 15, 59, micro=420019)),
    ("2023-01-08T16:57:31−03:30", us(2023, 1, 8, 20, 27, 31)),
    ("2023-01-01T00:43:19+00", us(2023, 1, 1, 0, 43, 19)),
    ("2023-01-02T08:29:34+05:45[Asia/Kathmandu]", us(2023, 1, 2, 2, 44, 34)),
    ("20230106T183810Z", us(2023, 1, 6, 18, 38, 10)),
    ("Mon, 02 Jan 2023 12:12:48 -0330", us(2023, 1, 2, 15, 42, 48)),
    ("Jan 11, 2023 12:10:10 AM UTC", us(2023, 1, 11, 0, 10, 10)),
    ("2025-10-26 02:27:31 CEST", us(2025, 10, 26, 0, 27, 31)),
    ("1672559793282", 1672559793282000),
    ("1672601384", 1672601384000000),
    ("1672541597837902", 1672541597837902),
    ("1672541597837902999", 1672541597837902),
    ("2023年1月12日 23時43分00秒", us(2023, 1, 12, 22, 43)),
    ("03.01.2023 12:42:28", us(2023, 1, 3, 11, 42, 28)),
    ("06/01/2023 12:11:52 am", us(2023, 1, 5, 23, 11, 52)),
    ("2023-01-04 09:08", us(2023, 1, 4, 8, 8)),
    ("2023/01/06 14:14:48", us(2023, 1, 6, 13, 14, 48)),
    ("2025-03-30 02:57", us(2025, 3, 30, 1, 57)),  # skipped: forward by the gap
    ("2025-10-26 02:30:00", us(2025, 10, 26, 0, 30)),  # twice: the earlier
    ("2023-01-01 18:19:46 Asia/Tokyo", us(2023, 1, 1, 9, 19, 46)),
    *[(x, None) for x in ("", "unknown", "-", "2026-03-", "0001-01-01T00:00:00", "0000-01-01T00:00:00Z", "2025-11-09 10:61:00 UTC", "2025-13-04T08:00:00Z", "2024-06-31T05:10:00+02:00", "2024-06-30T25:10:00Z", "13/13/2024 10:00:00", "06/01/2023 13:11:52 am", "2023-01-01 10:00:00 Mars/Base", "12345", "99999999999999999999999", None)],
]


def test_forms(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k INT, t STRING")
    got = {r.k: r.u for r in with_instant(df, "t", "u", F.lit("Europe/Berlin")).collect()}
    assert {CASES[k][0]: got[k] for k in got} == dict(CASES)


def test_no_default_zone_and_month_first(spark):
    df = spark.createDataFrame([(1, "2023-01-01 10:00:00", "mdy"), (2, "01/20/2023 10:00:00 UTC", "mdy"), (3, "01/02/2023 10:00:00 Z", None)], "k INT, t STRING, o STRING")
    got = {r.k: r.u for r in with_instant(df, "t", "u", None, F.col("o")).where("k > 0").collect()}
    assert got == {1: None, 2: us(2023, 1, 20, 10), 3: us(2023, 2, 1, 10)}


@pytest.mark.parametrize("ambiguous,nonexistent,twice,skipped", [("earlier", "forward", us(2025, 11, 2, 5, 30), us(2025, 3, 9, 7, 30)), ("later", "null", us(2025, 11, 2, 6, 30), None), ("null", "null", None, None)])
def test_policies(spark, ambiguous, nonexistent, twice, skipped):
    row = spark.range(1).select(*[local_to_utc(F.lit(x), F.lit("America/New_York"), ambiguous, nonexistent) for x in (us(2025, 11, 2, 1, 30), us(2025, 3, 9, 2, 30), us(2025, 3, 9, 2, 30) + DAY_US)]).first()
    assert tuple(row) == (twice, skipped, us(2025, 3, 10, 6, 30))


def test_tables_with_nulls_extra_columns_and_none(spark):
    schema = "delivery_id LONG, project_id INT, created_at STRING, _zone STRING, utc_us STRING"
    oa = spark.createDataFrame([(1, 1, "2023-06-01 10:00", "x", "y"), (1, 1, "2023-06-01 10:00", "x", "y"), (2, None, "2023-06-01 10:00", "x", "y"), (3, 2, "2023-06-01 10:00", "x", "y"), (4, None, "2023-06-01T10:00Z", None, None), (5, 1, None, None, None)], schema)
    mr = spark.createDataFrame([], "mr_row LONG, target_project_id INT, updated_at STRING")
    issue = spark.createDataFrame([(9, 1, "x")], "issue_row LONG, project_id INT, created_at STRING")
    projects = spark.createDataFrame([(1, "Asia/Tokyo", "dmy"), (2, None, "dmy"), (None, "Asia/Tokyo", None)], "id INT, time_zone STRING, date_order STRING")
    got = sorted(tuple(r) for r in instants({"object_attributes": oa, "merge_request": mr, "issue": issue}, projects).collect())
    assert got == [("object_attributes", 1, us(2023, 6, 1, 1)), ("object_attributes", 1, us(2023, 6, 1, 1)), ("object_attributes", 4, us(2023, 6, 1, 10))]
