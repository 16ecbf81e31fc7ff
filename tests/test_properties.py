"""Properties that hold for any table, on random small ones."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators import checks as C
from plumbline.operators import duplicates as D
from plumbline.operators import profile as P
from plumbline.operators import suite as S

few = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
rows = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(-3, 3)),
        st.one_of(st.none(), st.floats(-5, 5), st.just(math.nan)),
        st.one_of(st.none(), st.sampled_from(["", "a", "a@b.cd", "URGENT", "x" * 1200])),
    ),
    max_size=25,
)


def frame(spark, data):
    return spark.createDataFrame(data, "a int, b double, subject string")


def missing(value):
    return value is None or (isinstance(value, float) and math.isnan(value))


@few
@given(data=rows)
def test_score_is_a_percentage_of_the_checks(spark, data):
    results = S.run_suite(frame(spark, data), ranges={"a": {"min": 0}})
    row = S.quality_score(results).first()
    assert 0 <= row.quality_score <= 100
    status = [r.status for r in results.collect() if r.status is not None]
    assert row.total_checks == len(status)
    assert row.quality_score == pytest.approx(100 * status.count("Success") / len(status))


@few
@given(data=rows)
def test_counts_equal_python(spark, data):
    df = frame(spark, data)
    for i, row in enumerate(C.completeness(df).collect()):
        column = [r[i] for r in data]
        assert row.null_count == sum(map(missing, column))
        if data:
            assert row.completeness_ratio + row.null_count / len(data) == pytest.approx(1)
    for i, row in enumerate(C.uniqueness(df).collect()):
        column = {r[i] + 0.0 if i == 1 else r[i] for r in data if not missing(r[i])}
        assert row.distinct_count == len(column)


@few
@given(data=rows)
def test_duplicates_are_rows_less_distinct_rows(spark, data):
    df = frame(spark, data)
    plain = {tuple(None if missing(v) else v for v in r) for r in data}
    assert D.duplicate_rows(df).first().duplicate_rows == len(data) - len(plain)


@few
@given(data=rows, bins=st.integers(1, 7))
def test_histogram_holds_every_value(spark, data, bins):
    found = P.histogram(frame(spark, data), bins=bins).collect()
    for i, name in ((0, "a"), (1, "b")):
        values = [r[i] for r in data if not missing(r[i])]
        mine = [r for r in found if r.column_name == name]
        assert sum(r.value_count for r in mine) == len(values)
        assert len(mine) == (0 if not values else 1 if len(set(values)) == 1 else bins)
