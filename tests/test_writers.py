"""Partitioned writes by a plan of files."""

import math
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from pairwise import session
from pairwise.checks import consensus
from pairwise.sinks import files


def models(spark):
    """One model with two thirds of the rows, one without a name, and many small ones."""
    n = 6000
    k = F.col("id")
    hot = F.when(k % 3 < 2, "hot").when(k % 30 == 2, None).otherwise(F.concat(F.lit("m"), (k % 40).cast("string")))
    return spark.range(0, n, 1, 12).select(
        F.lit("t").alias("model_type"), hot.alias("model_name"), F.format_string("%09d", "id").alias("cell"),
        F.when(k % 7 == 0, None).otherwise("x").alias("note"),
    )


def written(path):
    found = {}
    for part in Path(path).glob("model_type=*/model_name=*/part-*.csv"):
        name = part.parent.name.removeprefix("model_name=")
        found.setdefault(name, []).append(part.read_text().splitlines()[1:])
    return found


@pytest.mark.parametrize("target", [5_000, 100_000, 1 << 30])
def test_files_of_a_model_follow_its_bytes(spark, tmp_path, target):
    frame = models(spark)
    rows = {}
    for r in frame.collect():
        name = r.model_name or "__HIVE_DEFAULT_PARTITION__"
        rows.setdefault(name, []).append((r.cell, f"{r.cell},{r.note or ''}"))
    keys = ["model_type", "model_name"]
    files.write_csv(files.planned(frame, keys, target), str(tmp_path / "out"), tuple(keys))
    found = written(tmp_path / "out")
    assert {k: sorted(sum(v, [])) for k, v in found.items()} == {k: sorted(x for _, x in v) for k, v in rows.items()}
    for name, parts in found.items():
        known = "" if name.startswith("__") else name
        size = sum(len(f"t,{known},{text}") + 1 for _, text in rows[name])
        assert len(parts) == math.ceil(size / target)
        if len(parts) > 1:
            assert max(map(len, parts)) < 2 * sum(map(len, parts)) / len(parts)


def test_small_models_share_tasks(spark):
    dealt = files.planned(models(spark), ["model_type", "model_name"], 1 << 30)
    assert dealt.rdd.getNumPartitions() == 1
    assert files.planned(models(spark), ["model_type", "model_name"], 20_000).rdd.getNumPartitions() < 10


def test_no_rows(spark, tmp_path):
    keys = ["model_type", "model_name"]
    files.write_csv(files.planned(models(spark).limit(0), keys), str(tmp_path / "out"), tuple(keys))
    assert not written(tmp_path / "out")


def test_byte_order_mark(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, "é"), ("b", 2, "日")], "kind string, n int, text string")
    files.write_csv(frame.repartition(1), str(tmp_path / "out"), ("kind",), bom=True)
    (part,) = (tmp_path / "out" / "kind=b").glob("part-*.csv")
    assert part.read_bytes() == "\ufeffn,text\n2,日\n".encode()
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert set(back.columns) == {"n", "text", "kind"}


@pytest.mark.parametrize("open_files", [100, 3])
def test_a_run_is_written_without_sorting_the_rows_of_a_model(spark, tmp_path, monkeypatch, open_files):
    """Rows stream into the files of their models; models beyond the open files are written too."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(name), []
    plain = DataFrameWriter.csv
    monkeypatch.setattr(session, "OPEN_FILES", open_files)
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, *a, **b: (seen.append(spark.conf.get(name)), plain(self, *a, **b))[1])
    rows = spark.range(3_000).select(
        F.lit(25.0).alias("l_quantity"), (F.col("id") % 2).cast("string").alias("l_linestatus"), (F.col("id") % 7).alias("l_linenumber"),
        F.col("id").alias("l_suppkey"), F.col("id").alias("l_partkey"),
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = consensus.QUERIES["discovered_files"](spark, str(tmp_path)).collect()
    assert sorted((r.model_dir, r.model_name) for r in found) == sorted((f"M{k}", f"m{i}") for k in range(2) for i in range(7))
    assert sum(r.records for r in found) == 3_000 and {r.records for r in found} <= {214, 215}
    assert seen == [str(open_files)] and spark.conf.get(name) == before
    read = consensus.QUERIES["prediction_files"](spark, str(tmp_path))
    assert read.select("protein_id").distinct().count() == read.count() == 3_000
