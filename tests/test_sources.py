import os

import pytest
from conftest import collect
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areacast.sources import codebook as cb
from areacast.sources.shared import settle, shared_folder
from areacast.sources.tables import read_csv, read_table, shape, write_table


def test_read_csv_by_cleaned_name(spark, raw, raw_files):
    df = read_csv(spark, raw_files["survey"], cb.SURVEY_RAW)
    assert df.columns == [f.name for f in cb.SURVEY_RAW]
    assert [f.dataType for f in df.schema] == [f.dataType for f in cb.SURVEY_RAW]
    assert df.count() == len(raw["survey"])
    missing = int(raw["survey"]["pew_religimp"].isna().sum())
    assert df.filter(F.col("pew_religimp").isNull()).count() == missing > 0


def test_read_csv_invalid_cells_are_missing(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("YEAR,STATE,RATE,z\n2019,AL,7.5,1\nabc,NA,-,2\n2020, AK ,,3\n")
    rows = collect(read_csv(spark, str(path), cb.HOMICIDE), "rate", "year")
    assert rows[0] == {"year": 2019, "state": "AL", "rate": 7.5}
    assert {"year": 2020, "state": "AK", "rate": None} in rows
    assert {"year": None, "state": None, "rate": None} in rows


def test_read_csv_reports_missing_columns(spark, raw_files):
    schema = T.StructType([T.StructField("nowhere", T.StringType())])
    with pytest.raises(ValueError, match="nowhere"):
        read_csv(spark, raw_files["survey"], schema)


def test_csv_scan_prunes_columns(spark, raw_files):
    df = read_csv(spark, raw_files["survey"], cb.SURVEY_RAW).select("gender")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<gender:string>" in plan


def test_write_and_read_table(spark, tmp_path):
    df = spark.createDataFrame([("AL", 1), ("AK", 2)], "abb string, x int")
    path = str(tmp_path / "t")
    write_table(df, path, partition_by="abb")
    assert "abb=AL" in os.listdir(path)
    assert collect(read_table(spark, path).select("abb", "x"), "x") == collect(df, "x")
    with pytest.raises(Exception, match="already exists"):
        write_table(df, path)
    write_table(df.limit(1), path, mode="overwrite")
    assert read_table(spark, path).count() == 1


def test_shape(spark):
    df = spark.range(7).withColumn("x", F.lit(1))
    assert shape(df).first().asDict() == {"n_rows": 7, "n_columns": 2}


def test_settle_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    table = settle(spark.range(10).withColumn("x", F.col("id") * 2.0))
    assert table.inputFiles()[0].startswith(f"file://{folder}")
    assert table.agg(F.sum("x")).first()[0] == 90.0
    # The lineage is cut: only a file scan is left.
    assert "Range" not in table._jdf.queryExecution().executedPlan().toString()


def test_settle_keeps_an_empty_table(spark):
    table = settle(spark.createDataFrame([], "a string, b double"))
    assert table.count() == 0 and table.columns == ["a", "b"]


def test_partitioned_write_makes_one_file_per_small_area(spark, tmp_path):
    df = spark.range(4000, numPartitions=16).withColumn("abb", F.concat(F.lit("a"), F.col("id") % 5))
    path = tmp_path / "t"
    write_table(df, str(path), partition_by="abb")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in path.iterdir() if d.is_dir()}
    assert files == {f"abb=a{k}": 1 for k in range(5)}


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('case_id,note\n1,"a\nb, c"\n2,"say ""hi"""\n3,NA\n')
    schema = T.StructType().add("case_id", "long").add("note", "string")
    rows = [tuple(r) for r in read_csv(spark, str(path), schema).orderBy("case_id").collect()]
    assert rows == [(1, "a\nb, c"), (2, 'say "hi"'), (3, None)]
