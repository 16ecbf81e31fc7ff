import math

import numpy as np
import pytest
from conftest import by

from plumbline.operators import anomalies as Z


@pytest.fixture
def readings(spark):
    rows = [(i, float(i % 10), i % 3) for i in range(100)]
    rows += [(100, 1000.0, 1), (101, -900.0, 1), (102, None, 2), (103, math.nan, 0)]
    return spark.createDataFrame(rows, "id bigint, x double, k int")


def test_counts_equal_pandas(readings):
    frame = readings.toPandas()
    rows = by(Z.detect_anomalies(readings, threshold=2.0))
    assert set(rows) == {"id", "x", "k"}
    for name, row in rows.items():
        values = frame[name].astype(float)
        mean, std = values.mean(), values.std()
        outside = (values < mean - 2 * std) | (values > mean + 2 * std)
        assert row["mean"] == pytest.approx(mean)
        assert row["std"] == pytest.approx(std)
        assert row.lower_bound == pytest.approx(mean - 2 * std)
        assert row.upper_bound == pytest.approx(mean + 2 * std)
        assert row.anomaly_count == outside.sum()
        assert row.anomaly_percentage == pytest.approx(outside.sum() / len(frame) * 100)


def test_rows_keep_the_callers_keys(readings):
    bands = Z.fit_bands(readings)
    rows = Z.anomaly_rows(readings, bands, ["id"]).collect()
    assert sorted((r.column_name, r.id, r.value) for r in rows) == [
        ("x", 100, 1000.0),
        ("x", 101, -900.0),
    ]


def test_headline_counts_columns_both_ways(readings):
    row = Z.anomaly_headline(Z.detect_anomalies(readings)).first()
    assert (row.total_anomalies, row.columns_analysed) == (2, 3)
    assert row.columns_with_anomalies == 1
    assert row.average_percentage == pytest.approx(2 / 104 * 100 / 3)


def test_histogram_holds_every_anomaly(readings):
    bands = Z.fit_bands(readings)
    rows = Z.anomaly_histogram(readings, bands, bins=5).collect()
    assert sum(r.value_count for r in rows) == 2
    assert {r.column_name for r in rows} == {"x"}
    assert len(rows) == 5
    assert rows[0].lower_bound == bands["x"].lower


@pytest.mark.parametrize("values", [[], [3.0], [None, None]])
def test_too_few_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = Z.detect_anomalies(df).first()
    assert (row["std"], row.lower_bound, row.anomaly_count) == (None, None, 0)
    assert row.anomaly_percentage == (None if not values else 0.0)
    assert Z.anomaly_rows(df, Z.fit_bands(df)).count() == 0


def test_unknown_columns_are_skipped_and_text_refused(readings, people):
    assert set(Z.fit_bands(readings, ["x", "nope"])) == {"x"}
    with pytest.raises(ValueError):
        Z.fit_bands(people, ["name"])


def test_sample_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert Z.fit_bands(df)["x"].std == pytest.approx(np.std([1, 2, 4], ddof=1))


@pytest.mark.parametrize("values", [
    [1.0, 2.0, math.inf], [1.0, -math.inf, math.inf, 3.0], [5.0], [math.nan, math.nan], [2.0] * 4
])
def test_no_band_without_a_finite_deviation(spark, values):
    df = spark.createDataFrame([(v,) for v in values + [None]], "v double")
    row = Z.detect_anomalies(df).first()
    assert (row.anomaly_count, row.total_count) == (0, len(values) + 1)
    assert Z.anomaly_rows(df, Z.fit_bands(df)).count() == 0
    assert Z.anomaly_histogram(df, Z.fit_bands(df)).count() == 0


def test_infinite_hits_of_a_given_band_are_in_no_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 9.0, 11.0, math.inf)], "v double")
    bins = Z.anomaly_histogram(df, {"v": Z.Band(0.0, 1.0)}, bins=2).collect()
    assert sum(b.value_count for b in bins) == 2
    assert all(math.isfinite(b.upper_edge) for b in bins)
