"""Sources and sinks on files in a temporary folder."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairwise.constants import DESCRIPTORS
from pairwise.operators.entities import run_totals, unique_proteins
from pairwise.operators.pairs import pair_stats
from pairwise.params import ConsensusParams
from pairwise.plans.consensus import run_exports
from pairwise.plans.features import run_features
from pairwise.session import owned_staging, stage
from pairwise.sinks import files, tables
from pairwise.sources import predictions as sources
from pairwise.sources import runs
from pairwise.sources.descriptors import read_descriptors
from pairwise.sources.interactions import read_interactions, resolve_columns
from pairwise.sources.profiles import attach_profiles, profile_texts, read_profiles
from pairwise.sources.store import Store, extend_store


def put(path: Path, text: str, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def read_parts(folder: Path) -> list[dict]:
    """Rows of a CSV folder, part files by name."""
    rows = []
    for part in sorted(folder.glob("part-*.csv")):
        with part.open(newline="", encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    return rows


# ---- interactions ------------------------------------------------------------------------------

HEADER = "ProteinID,Seq,CID,SMILES,Class\n"


def test_aliases_are_exact_and_ordered():
    found = resolve_columns(["label", "Label", "accession", "ProteinID", "Accession", "CID"])
    assert found["accession"] == "Accession" and found["label"] == "label"
    assert found["compound_cid"] == "CID" and found["sequence"] is None


def test_interactions(spark, tmp_path):
    text = '﻿' + HEADER + ' P1\t, acd ,C1,"C(""x"")\\C",1\r\nP2,mkv,C2,CC,\r\n"P,3",A,C1,O,0\r\n'
    put(tmp_path / "a.csv", text)
    rows = read_interactions(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [
        (1, "P1", "ACD", "C1", 'C("x")\\C', "1"),
        (2, "P2", "MKV", "C2", "CC", ""),
        (3, "P,3", "A", "C1", "O", "0"),
    ]


def test_interactions_without_label(spark, tmp_path):
    put(tmp_path / "a.csv", "Protein_Accession,Sequence,Compound_CID,Smile\nP,A,C,S\n")
    assert read_interactions(spark, str(tmp_path / "a.csv")).first().label == ""


def test_missing_required_column(spark, tmp_path):
    put(tmp_path / "a.csv", "Protein_Accession,Sequence,Compound_CID\nP,A,C\n")
    with pytest.raises(ValueError, match="smile"):
        read_interactions(spark, str(tmp_path / "a.csv"))


def test_names_that_differ_in_case_only(spark, tmp_path):
    put(tmp_path / "a.csv", "SMILES,Label,Smile,label,CID,Seq,Accession,Note.1\nx,no,S,yes,C,A,P,n\n")
    row = read_interactions(spark, str(tmp_path / "a.csv")).first()
    assert (row.smile, row.label) == ("S", "yes")


def test_line_breaks_in_quotes(spark, tmp_path):
    put(tmp_path / "a.csv", HEADER + 'P,"A\nC",C,S,1\nQ,M,D,T,0\n')
    rows = read_interactions(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy("row_no").collect()
    assert [(r.row_no, r.sequence) for r in rows] == [(1, "A\nC"), (2, "M")]


def test_empty_ids_are_ids(spark, tmp_path):
    put(tmp_path / "a.csv", HEADER + ",ACD,,CCO,1\n,MKV,,CCO,\nP,A,C,,0\n")
    rows = read_interactions(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [(r.accession, r.compound_cid, r.smile) for r in rows] == [("", "", "CCO"), ("", "", "CCO"), ("P", "C", "")]
    frame = spark.createDataFrame(rows)
    totals = run_totals(frame).first()
    assert (totals.unique_proteins, totals.unique_compounds) == (2, 2)
    assert [r.sequence for r in unique_proteins(frame).orderBy("first_row").collect()] == ["ACD", "A"]


def test_cells_beyond_the_header_are_dropped_and_missing_ones_refused(spark, tmp_path):
    put(tmp_path / "a.csv", HEADER + 'P,"A,C",C1,S,1,\nQ,A,C2,S,,,x\n')
    rows = read_interactions(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [(r.accession, r.sequence, r.label) for r in rows] == [("P", "A,C", "1"), ("Q", "A", "")]
    put(tmp_path / "b.csv", HEADER + "P,A,C1,S,1\nQ,A,C2\n")
    with pytest.raises(Exception, match="missing cells"):
        read_interactions(spark, str(tmp_path / "b.csv")).collect()


def test_files_of_unlike_headers(spark, tmp_path):
    put(tmp_path / "in" / "a.csv", HEADER + "P1,ACD,C1,S1,1\n")
    put(tmp_path / "in" / "b.csv", "CID,Class,SMILES,ProteinID,Seq\nC2,0,S2,P2,MKV\n")
    put(tmp_path / "in" / "_SUCCESS", "")
    rows = read_interactions(spark, str(tmp_path / "in")).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [(1, "P1", "ACD", "C1", "S1", "1"), (2, "P2", "MKV", "C2", "S2", "0")]
    put(tmp_path / "d" / "a.csv", "SMILES,MW\nCC,30\n")
    put(tmp_path / "d" / "b.csv", "LogP,SMILES\n1.5,O\n")
    table = {r.smile: r for r in read_descriptors(spark, str(tmp_path / "d")).collect()}
    assert table["CC"].MW == 30 and table["O"].LogP == 1.5


@pytest.mark.parametrize("split", ["1k", "7k", "1m"])
def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path, split):
    for name, first in (("part 1%.csv", 0), ("part-2.csv", 900)):
        body = "".join(f"P{i},ACD,C{i},S,{i}\n" for i in range(first, first + 900))
        put(tmp_path / "in" / name, HEADER + body)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_interactions(spark, str(tmp_path / "in")).collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sorted((r.row_no, r.label) for r in rows) == [(i + 1, str(i)) for i in range(1800)]


# ---- descriptors and profiles ------------------------------------------------------------------


def test_descriptor_file(spark, tmp_path):
    put(tmp_path / "d.csv", "﻿SMILES,LogP,MW,RO5_Violations,Unknown\r\nCC,1.5,30,True,9\r\nO,,18,False,9\r\n")
    table = read_descriptors(spark, str(tmp_path / "d.csv"))
    assert set(table.columns) - {"smile"} <= set(DESCRIPTORS)
    rows = {r.smile: r for r in table.collect()}
    assert (rows["CC"].MW, rows["CC"].LogP, rows["CC"].RO5_Violations) == (30, 1.5, 1.0)
    assert rows["O"].LogP != rows["O"].LogP


def test_profile_files(spark, tmp_path):
    scores = " ".join(str(i) for i in range(-5, 15))
    text = (
        "\n7 looks like data but is too short\n\n"
    )
    put(tmp_path / "early.pssm", text + f"1 A {scores}\n")
    put(
        tmp_path / "p+1 %.pssm",
        "\nLast position-specific scoring matrix computed\n   A R N D\n"
        f"    1 M {scores} 0.1 0.2\n    2 K {scores.replace('14', 'x')}\n    3 V {scores}\r\n    4 V 1 2\n"
        f"   K  Lambda inside\n    5 A {scores}\n\n    6 A {scores}\nLambda 1\n",
    )
    rows = read_profiles(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.stem, r.pos) for r in rows] == [("p+1 %", 1), ("p+1 %", 2), ("p+1 %", 3)]
    assert rows[0].scores == [float(i) for i in range(-5, 15)]


# ---- prediction runs ---------------------------------------------------------------------------


@pytest.fixture
def run_dir(tmp_path):
    run = tmp_path / "runs" / "batch_prediction_20240102_000000"
    put(tmp_path / "runs" / "batch_prediction_20231231_235959" / "x" / "a_prediction.csv", "protein_id\n")
    put(tmp_path / "runs" / "other_20990101" / "x" / "a_prediction.csv", "protein_id\n")
    full = "protein_id,compound_id,prediction,probability_0,probability_1,confidence\n"
    put(run / "deep_net" / "a_prediction.csv", full + "P1,C1,1,0.1,0.9,0.9\nP1,C2,0,0.8,0.2,\n")
    put(run / "deep_net" / "b c+é_prediction.csv", "prediction,confidence,compound_id,protein_id\n1,0.7,C1,P1\n")
    put(run / "svm" / "a_prediction.csv", full + "P1,C1,1,0.3,0.7,0.7\n007,C2,1,0.3,0.7,0.7\n")
    put(run / "svm" / "empty_prediction.csv", "")
    put(run / "svm" / "notes.csv", "protein_id\n")
    put(run / ".hidden" / "z_prediction.csv", full + "P9,C9,1,0,1,1\n")
    return run


def test_latest_run(spark, run_dir):
    assert runs.latest_run(spark, str(run_dir.parent)).endswith("batch_prediction_20240102_000000")
    assert runs.latest_run(spark, str(run_dir.parent / "nothing")) is None


def test_discovery(spark, run_dir):
    frame = sources.read_predictions(spark, base=str(run_dir.parent))
    rows = {(r.model_type, r.model_name, r.protein_id, r.compound_id): r for r in frame.collect()}
    assert set(rows) == {
        ("deep_net", "a", "P1", "C1"), ("deep_net", "a", "P1", "C2"), ("deep_net", "b c+é", "P1", "C1"),
        ("svm", "a", "P1", "C1"), ("svm", "a", "007", "C2"),
    }
    other = rows["deep_net", "b c+é", "P1", "C1"]
    assert (other.prediction, other.confidence, other.probability_0, other.probability_1) == (1, 0.7, 0.5, 0.5)
    gap = rows["deep_net", "a", "P1", "C2"]
    assert gap.confidence != gap.confidence and gap.probability_1 == 0.2


def test_summary_names_the_models(spark, run_dir):
    summary = {"deep/net": {"a": {"auc": 1}, "gone": {}}, "svm": {}, "missing": {"a": None}}
    put(run_dir / "prediction_summary.json", json.dumps(summary, indent=1))
    frame = sources.read_predictions(spark, str(run_dir))
    assert {(r.model_type, r.model_name) for r in frame.select("model_type", "model_name").collect()} == {("deep/net", "a")}


def test_summary_with_types_but_no_models_loads_nothing(spark, run_dir):
    put(run_dir / "prediction_summary.json", json.dumps({"svm": {}}))
    with pytest.raises(FileNotFoundError):
        sources.read_predictions(spark, str(run_dir))


def test_files_that_readers_hide(spark, run_dir):
    put(run_dir / "svm" / "_b_prediction.csv", "protein_id,compound_id,prediction\nP7,C7,1\n")
    put(run_dir / "_net" / "c_prediction.csv", "protein_id,compound_id,prediction\nP8,C8,1\n")
    found = {(r.model_type, r.model_name) for r in sources.read_predictions(spark, str(run_dir)).collect()}
    assert {("svm", "_b"), ("_net", "c")} <= found and len(found) == 5


def test_every_header_cell_is_kept(spark, tmp_path):
    run = tmp_path / "run"
    put(run / "a" / "x_prediction.csv", "protein_id,compound_id,prediction,score,score,,model_type\nP,C,1,5,7,z,own\n")
    put(run / "b" / "y_prediction.csv", "protein_id,compound_id,prediction,Confidence\nP,C,1,0.9\n")
    put(run / "b" / "z_prediction.csv", "protein_id,compound_id,prediction,confidence\nP,C,1,0.8\n")
    raw = sources.read_raw_models(spark, str(run))
    combined = sources.union_models(raw)
    assert {"score", "score.1", "Unnamed: 5", "Confidence", "confidence"} <= set(combined.columns)
    typed = {r.model_name: r for r in sources.read_predictions(spark, str(run)).collect()}
    assert (typed["y"].confidence, typed["z"].confidence) == (0.5, 0.8)
    out = str(tmp_path / "out")
    files.write_models(raw, combined, pair_stats(sources.read_predictions(spark, str(run))), ConsensusParams(), out, str(run))
    (own,) = [p for p in Path(out).glob("models/*/of_model_type=a/of_model_name=x/part-*.csv")]
    assert own.read_text() == "protein_id,compound_id,prediction,score,score.1,Unnamed: 5,model_type\nP,C,1,5,7,z,own\n"
    (settings,) = [json.loads(p.read_text()) for p in Path(out).glob("parameters/part-*.json")]
    assert settings["data_source"] == str(run)
    (row,) = [r for r in read_parts(Path(out) / "all_predictions_combined") if r["model_name"] == "x"]
    assert (row["model_type"], row["score"], row["score.1"]) == ("a", "5", "7")


def test_profile_names_that_readers_hide(spark, tmp_path):
    line = "1 A " + " ".join(["3"] * 20) + "\n"
    put(tmp_path / "_P1.pssm", line)
    put(tmp_path / "P2.pssm", line)
    assert sorted(r.stem for r in read_profiles(spark, str(tmp_path)).collect()) == ["P2", "_P1"]
    proteins = spark.createDataFrame([("|P1",), ("P3",)], "accession string")
    assert [r.accession for r in attach_profiles(proteins, profile_texts(spark, str(tmp_path))).collect()] == ["|P1"]


@pytest.mark.parametrize("text", ["{ broken", "{}"])
def test_useless_summary_falls_back_to_discovery(spark, run_dir, text):
    put(run_dir / "prediction_summary.json", text)
    assert sources.read_predictions(spark, str(run_dir)).count() == 5


def test_run_without_readable_files(spark, tmp_path):
    put(tmp_path / "run/svm/empty_prediction.csv", "")
    with pytest.raises(FileNotFoundError):
        sources.read_predictions(spark, str(tmp_path / "run"))


def test_exports(spark, run_dir, tmp_path):
    out = tmp_path / "out"
    stats = run_exports(spark, str(run_dir), str(out), ConsensusParams(min_consensus=1))
    assert stats.count() == 3
    basic = read_parts(out / "basic/summary/strategy=all_positive")
    assert [(r["protein_id"], r["compound_id"]) for r in basic] == [("P1", "C1"), ("007", "C2")]
    assert basic[0]["avg_confidence"] == "0.7667" and basic[1]["avg_probability_0"] == "0.3000"
    detail = read_parts(out / "detailed/detailed/strategy=all_positive")
    assert len(detail) == 4 and detail[0]["prediction_label"] == "相互作用"
    assert {r["prediction"] for r in detail} == {"1"}
    combined = read_parts(out / "complete/all_predictions_combined")
    assert len(combined) == 5 and {r["protein_id"] for r in combined} == {"P1", "007"}
    by_model = sorted(p.name for p in (out / "complete/models").glob("*/model_type=svm/*"))
    assert by_model == ["model_name=a"]
    (settings,) = [json.loads(p.read_text()) for p in (out / "basic/parameters").glob("part-*.json")]
    assert settings["total_models"] == 3 and settings["total_compounds_analyzed"] == 3
    report = read_parts(out / "report")
    assert report[0] == {"section": "1_overview", "ord": "1", "key": "total_compounds_analyzed", "value": "3"}


def test_empty_strategy_gives_no_folder(spark, run_dir, tmp_path):
    predictions = sources.read_predictions(spark, str(run_dir))
    files.write_basic(pair_stats(predictions), predictions, ConsensusParams(min_consensus=9), str(tmp_path / "e"))
    assert not list((tmp_path / "e/summary").glob("strategy=*"))


def test_resumable_runs(spark, tmp_path):
    put(tmp_path / "a_features_1/progress.json", json.dumps({"completed": True, "total_proteins": 5}))
    put(tmp_path / "b_features_2/progress.json", json.dumps({"proteins_processed": 2, "total_proteins": 5}))
    put(tmp_path / "c_features_3/cache/x.json", "{}")
    put(tmp_path / "d_other/progress.json", "{}")
    rows = runs.resumable_runs(spark, str(tmp_path)).collect()
    assert [(r.run_dir, r.status) for r in rows] == [
        ("a_features_1", "complete"), ("b_features_2", "incomplete"), ("c_features_3", "no file"),
    ]
    assert (rows[1].proteins_processed, rows[1].total_proteins) == (2, 5)


# ---- feature runs ------------------------------------------------------------------------------


def test_store_computes_each_entity_once(spark, tmp_path):
    seen = []

    def compute(todo):
        frame = todo.select("k", F.length("k").alias("n"))
        seen.append(frame)
        return frame

    unique = spark.createDataFrame([("a",), ("bb",)], "k string")
    first = extend_store(unique, str(tmp_path / "s"), "k", compute)
    assert first.count() == 2
    more = spark.createDataFrame([("a",), ("ccc",)], "k string")
    again = extend_store(more, str(tmp_path / "s"), "k", compute)
    assert sorted(tuple(r) for r in again.collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]
    assert [r.k for r in seen[-1].collect()] == ["ccc"]


def test_a_killed_run_keeps_its_finished_batches(spark, tmp_path):
    unique = spark.range(40).select(F.col("id").cast("string").alias("k"))
    calls = []

    def compute(todo):
        calls.append(1)
        if len(calls) == 4:  # one call for the schema, two batches, then it stops
            raise RuntimeError("killed")
        return todo.select("k", F.length("k").alias("n"))

    with pytest.raises(RuntimeError):
        extend_store(unique, str(tmp_path / "s"), "k", compute, commit=10)
    kept = Store(spark, str(tmp_path / "s"), spark.read.parquet(str(tmp_path / "s/data")).drop("batch").schema, "k")
    assert len(kept.batches) == 2 and 0 < kept.features().count() < 40
    calls[:] = [0] * 10
    assert extend_store(unique, str(tmp_path / "s"), "k", compute, commit=10).count() == 40


def test_output_out_of_order_is_found(spark):
    good = spark.createDataFrame([(1, 1), (2, 2)], "row_no long, position long")
    assert tables.order_passed(good, 2) and not tables.order_passed(good, 3)
    assert not tables.order_passed(spark.createDataFrame([(1, 1), (1, 2)], good.schema), 2)


def test_owned_staging_is_deleted(spark):
    with owned_staging(spark):
        frame = stage(spark.range(3), "owned")
        path = frame.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert frame.count() == 3 and Path(path).exists()
    assert not Path(path).exists()


def test_frequent_pair_spreads_over_the_detailed_export(spark, tmp_path):
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    predictions = spark.range(n).select(
        F.lit("t").alias("model_type"), F.concat(F.lit("m"), F.col("id") % 50).alias("model_name"),
        F.concat(F.lit("P"), hot).alias("protein_id"), F.lit("C").alias("compound_id"), F.lit(1).alias("prediction"),
        F.lit(0.1).alias("probability_0"), F.lit(0.9).alias("probability_1"), F.lit(0.9).alias("confidence"),
    )
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_detailed(pair_stats(predictions), predictions, ConsensusParams(min_consensus=1), str(tmp_path / "x"))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    sizes = [sum(1 for _ in p.open()) - 1 for p in (tmp_path / "x/detailed").glob("strategy=*/part-*.csv")]
    assert sum(sizes) == 5 * n and max(sizes) < 2 * sum(sizes) / 32
    first = read_parts(tmp_path / "x/detailed/strategy=all_positive")
    assert [r["protein_id"] for r in first[: n // 3]] == ["P0"] * (n // 3)


@pytest.mark.parametrize("flagged", [False, True])
def test_feature_run(spark, tmp_path, flagged):
    rows = [("sp|P1", "ACD", "C1", "CCO", "1"), ("P2", "mkv", "C1", "other", "0"), ("sp|P1", "LATE", "C2", "N", "")]
    put(tmp_path / "in.csv", HEADER + "".join(",".join(r) + "\n" for r in rows * 20))
    line = "{} A " + " ".join(["2"] * 20) + "\n"
    put(tmp_path / "pssm/sp_P1.pssm", "\n" + line.format(1) + line.format(2))
    put(tmp_path / "d.csv", "SMILES,MW,LogP\nCCO,46.5,-0.1\n")
    args = [str(tmp_path / n) for n in ("in.csv", "pssm", "d.csv", "store")]
    run_features(spark, *args, str(tmp_path / "out"), flagged)
    combined = read_parts(tmp_path / "out/combined_features")
    assert len(combined) == 60 and len(combined[0]) == 338
    assert [r["Protein_Accession"] for r in combined] == [r[0] for r in rows * 20]
    assert [r["Label"] for r in combined] == [r[4] for r in rows * 20]
    first, second, third = combined[:3]
    assert first["Length"] == third["Length"] == "3.0" and first["AA_A"] == third["AA_A"]
    assert first["PSSM_Mean_A"] == "2.0" and second["PSSM_Mean_A"] == "0.0"
    assert first["Compound_MW"] == second["Compound_MW"] == "46.5" and third["Compound_MW"] == "0.0"
    assert first["Compound_CarbonCount"] == "2.0" and third["Compound_NitrogenCount"] == "1.0"
    detailed = read_parts(tmp_path / "out/detailed_features")
    assert len(detailed[0]) == (344 if flagged else 342)
    assert detailed[1]["Smile"] == "other"
    if flagged:
        unique = [(r["Protein_Is_Unique"], r["Compound_Is_Unique"]) for r in detailed[:4]]
        assert unique == [("true", "true"), ("true", "false"), ("false", "true"), ("false", "false")]
    order = read_parts(tmp_path / "out/order_verification")
    assert [r["Position"] for r in order] == [str(i + 1) for i in range(60)]
    assert {r["Order_OK"] for r in order} == {"YES"}
    (stats,) = [json.loads(p.read_text()) for p in (tmp_path / "out/processing_stats").glob("part-*.json")]
    assert (stats["total_records"], stats["unique_proteins"], stats["unique_compounds"]) == (60, 2, 2)
    assert (stats["rows_with_profile"], stats["proteins_with_profile"]) == (40, 1)
    assert stats["order_verification_passed"] and stats["resume_mode"] and stats["feature_dimensions"]["total"] == 335
    (settings,) = [json.loads(p.read_text()) for p in (tmp_path / "out/feature_settings").glob("part-*.json")]
    assert (settings["sequence_lags"], settings["search_iterations"], settings["profile"]["dimensions"]) == (10, 3, 220)
    with pytest.raises(FileExistsError):
        run_features(spark, *args, str(tmp_path / "new"), flagged, resume=False)
    # a second run finds everything in the store
    run_features(spark, *args, str(tmp_path / "again"), flagged)
    assert spark.read.parquet(str(tmp_path / "store/proteins/data")).count() == 2
    assert read_parts(tmp_path / "again/combined_features") == combined


def test_files_are_in_row_order(spark, tmp_path):
    frame = spark.range(1, 1001).select(F.col("id").alias("row_no")).repartition(5)
    files.write_csv(files.in_row_order(frame, rows_per_file=130), str(tmp_path / "o"))
    assert [int(r["row_no"]) for r in read_parts(tmp_path / "o")] == list(range(1, 1001))
    assert len(list((tmp_path / "o").glob("part-*.csv"))) == 8


def test_csv_cells_survive(spark, tmp_path):
    cells = ["", ' a"b', "c,d ", "e\\f", "C/C=C\\C"]
    spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "row_no int, t string").coalesce(1).createOrReplaceTempView("cells")
    files.write_csv(spark.table("cells"), str(tmp_path / "c"))
    assert [r["t"] for r in read_parts(tmp_path / "c")] == cells
