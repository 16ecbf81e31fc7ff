from conftest import by

from plumbline.operators.observed import Watched, written_and_measured


def test_measures_without_a_second_scan(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        scans.add(1)
        yield from batches

    df = spark.range(100).coalesce(1).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN double('NaN') WHEN id % 4 = 0 THEN NULL ELSE id / 2 END AS `a b`",
        "CASE WHEN id % 5 = 0 THEN '' ELSE 'x' END AS t",
    ).mapInArrow(counted, "id bigint, `a b` double, t string")
    found = by(written_and_measured(df, lambda rows: rows.write.parquet(str(tmp_path / "t"))))
    assert scans.value == 1
    present = [i / 2 for i in range(100) if i % 10 and i % 4]
    row = found["a b"]
    assert (row.total_count, row.null_count, row.min, row.max) == (100, 100 - len(present), 0.5, 49.5)
    assert row.mean == sum(present) / len(present)
    assert (found["t"].empty_count, found["t"].mean) == (20, None)
    # the rows are written as they are
    assert spark.read.parquet(str(tmp_path / "t")).where("isnan(`a b`)").count() == 10


def test_an_empty_table(spark):
    watched = Watched(spark.createDataFrame([], "a bigint, b string"))
    watched.rows.collect()
    row = by(watched.measures())["a"]
    assert (row.total_count, row.completeness, row.min) == (0, 0.0, None)
