from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import types as T

from callrank.functions import exprs as X
from crm_world import value


def test_clip_keeps_null_and_bounds(spark):
    assert value(spark, X.clip("x", 0, 100), x="CAST(NULL AS double)") is None
    assert value(spark, X.clip("x", 0, 100), x="-3D") == 0.0
    assert value(spark, X.clip("x", 0, 100), x="250D") == 100.0
    assert value(spark, X.cap("x", 1.0), x="CAST(NULL AS double)") is None
    assert value(spark, X.cap("x", 1.0), x="7D") == 1.0


def test_rounding_is_half_even_on_the_scaled_double(spark):
    raw = np.concatenate([np.arange(0, 2000) / 40.0, [27.05, 62.05, 42.25, 66.25]])
    df = spark.createDataFrame([(float(x),) for x in raw], "x double")
    ours = [r.v for r in df.selectExpr("x", f"{X.round_half_even('x', 1)} AS v").collect()]
    assert ours == np.round(raw, 1).tolist()


def test_days_ago_floors_times_of_day(spark):
    ref = date(2025, 5, 15)
    assert value(spark, X.days_ago("d", T.DateType(), ref), d="DATE '2025-05-10'") == 5
    noon = "TIMESTAMP '2025-05-10 12:00:00'"
    assert value(spark, X.days_ago("d", T.TimestampType(), ref), d=noon) == 4
    ntz = "TIMESTAMP_NTZ '2025-05-10 00:00:00'"
    assert value(spark, X.days_ago("d", T.TimestampNTZType(), ref), d=ntz) == 5
    assert value(spark, X.days_ago("d", T.StringType(), ref), d="'2025-05-20'") == -5
    assert value(spark, X.days_ago("d", T.StringType(), ref), d="'not a date'") is None
    assert (datetime(2025, 5, 15) - datetime(2025, 5, 10, 12)).days == 4


def test_lookup_defaults_for_null_and_unknown(spark):
    sql = X.lookup("x", {"VP": 0.85, "O'Neil": 0.5}, 0.2)
    assert value(spark, sql, x="'VP'") == 0.85
    assert value(spark, sql, x="'O\\'Neil'") == 0.5
    assert value(spark, sql, x="'Intern'") == 0.2
    assert value(spark, sql, x="CAST(NULL AS string)") == 0.2


def test_badges_and_flags(spark):
    sql = X.badges(["exclude_opted_out", "exclude_dnc_account"])
    row = dict(exclude_opted_out="true", exclude_dnc_account="CAST(NULL AS boolean)")
    assert value(spark, sql, is_excluded="true", dq_issue_count="2", **row) == "🚫 Opted Out | ⚠️ 2 DQ"
    assert value(spark, sql, is_excluded="false", dq_issue_count="0", **row) == ""
    active = value(spark, X.active_flags(["exclude_opted_out", "exclude_dnc_account"]), **row)
    assert active == ["Opted Out"]


def test_record_label(spark):
    sql = X.record_label()
    row = dict(rank="3", entity_id="'L1'", first_name="'Ann'", last_name="CAST(NULL AS string)")
    assert value(spark, sql, readiness_score="77.0D", **row) == "#3 | L1 | Ann  | Score: 77.0"
    unknown = value(spark, sql, readiness_score="CAST(NULL AS double)", **row)
    assert unknown == "#3 | L1 | Ann  | Score: "


@pytest.mark.parametrize("x", [0.693, 1e-7, 45, 1e9])
def test_numbers_are_doubles(spark, x):
    assert value(spark, X.number(x)) == float(x)
    assert value(spark, f"typeof({X.number(x)})") == "double"
