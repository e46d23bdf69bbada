import re

import numpy as np
import pandas as pd
import pytest

from callrank.plans.summaries import QUARTILES, numeric_summary, wide_summary

COLUMNS = ["score_a", "score_b", "same", "few", "gone"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "score_a": rng.random(997) * 100,
            # A third of all rows share one value, right at a quartile.
            "score_b": np.where(rng.random(997) < 0.34, 25.0, rng.random(997) * 100),
            "same": np.full(997, 12.5),
            "few": rng.integers(-3, 4, 997).astype(float),
            "gone": np.full(997, np.nan),
        }
    )
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in pdf.to_numpy()]
    schema = ", ".join(f"{c} double" for c in COLUMNS)
    return pdf, spark.createDataFrame(rows, schema)


def check(pdf, summary, columns):
    found = {r.metric: r for r in summary.collect()}
    for c in columns:
        expected = pdf[c].dropna().describe()
        row = found[c]
        assert row.n == expected["count"]
        if not row.n:
            assert row["mean"] is None and row.q50 is None
            continue
        got = [row["mean"], row["std"], row["min"], row.q25, row.q50, row.q75, row["max"]]
        assert got == pytest.approx(expected[1:].tolist(), abs=1e-9), c


def test_narrow_summary(frame):
    pdf, df = frame
    check(pdf, numeric_summary(df, COLUMNS), COLUMNS)


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_wide_summary_is_exact_whatever_the_buckets(frame, buckets):
    pdf, df = frame
    check(pdf, wide_summary(df, COLUMNS, buckets=buckets), COLUMNS)


def test_wide_summary_of_many_rows_and_coarse_sketches(spark):
    """The smallest sketch errs by a tenth: brackets are wide and overlap, values repeat and are missing."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({
        "even": rng.random(40_000), "steep": rng.lognormal(0, 4, 40_000), "few": rng.integers(0, 5, 40_000).astype(float),
        "hot": np.where(rng.random(40_000) < 0.5, 1.0, rng.random(40_000)), "gaps": np.where(rng.random(40_000) < 0.3, np.nan, rng.random(40_000)),
    })
    df = spark.createDataFrame(pdf).repartition(7)
    for k in (8, 64, 2048):
        check(pdf, wide_summary(df, list(pdf), k), list(pdf))


def test_wide_summary_reads_its_input_twice(spark, tmp_path):
    spark.range(1000).selectExpr("rand(1) AS x", "rand(2) AS y").write.parquet(str(tmp_path / "t"))
    summary = wide_summary(spark.read.parquet(str(tmp_path / "t")), ["x", "y"])
    summary.collect()
    plan = summary._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    run = [part.split("== Initial Plan ==")[0] for part in plan.split("== Final Plan ==")[1:]]
    # the profile and the counts, each a subquery that ran once
    assert sorted(len(re.findall(r"\+- Scan parquet", part)) for part in run) == [0, 1, 1]


def test_wide_summary_of_any_range(spark):
    """All values within a thousandth, a range of 1e12, and both: one value far off from all others."""
    rng = np.random.default_rng(5)
    close, broad = 7 + rng.random(400) / 1000, rng.random(400) * 1e12
    pdf = pd.DataFrame({"close": close, "broad": broad, "outlier": np.append(close[1:], 1e12)})
    df = spark.createDataFrame(pdf)
    found = {r.metric: r for r in wide_summary(df, list(pdf)).collect()}
    for c in pdf:
        expected = pdf[c].quantile([0.25, 0.5, 0.75]).tolist()
        assert [found[c].q25, found[c].q50, found[c].q75] == pytest.approx(expected, rel=1e-12), c


def test_single_value_and_pair(spark):
    one = wide_summary(spark.sql("SELECT 7D AS x"), ["x"]).first()
    assert (one.q25, one.q50, one.q75, one["std"]) == (7.0, 7.0, 7.0, None)
    two = wide_summary(spark.sql("SELECT explode(array(1D, 2D)) AS x"), ["x"]).first()
    assert (two.q25, two.q50, two.q75) == (1.25, 1.5, 1.75)
    assert list(QUARTILES) == ["q25", "q50", "q75"]
