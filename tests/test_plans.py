"""Physical plans: what is scanned, shuffled, and how hot keys are met."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from pairwise.checks import inputs
from pairwise.operators import agreement, assemble, consensus, distributions, entities, pairs, profiles, sequences
from pairwise.params import ConsensusParams
from pairwise.session import stage
from pairwise.sinks import tables

P = ConsensusParams()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Change runtime settings for one test."""
    old = {}

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            old[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield change
    for key, value in old.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="module")
def plans(spark, data):
    return {name: plan(query(spark, data)) for name, query in entry_points.QUERIES.items()}


def test_python_runs_only_where_bytes_or_matrices_are_counted(plans):
    """Letters of sequences and compound strings, products of model lists, grid cells, headers of files."""
    python = {name for name, text in plans.items() if re.search("Python|InPandas|InArrow", text)}
    assert python == {
        "aa_composition", "residue_zscores", "sequence_lag", "attach_protein", "combined_matrix",
        "detailed_matrix", "detailed_matrix_flags", "feature_dictionary", "element_census", "model_jaccard",
        "jaccard_summary", "jaccard_extremes", "model_complementarity", "threshold_grid", "discovered_files",
    }


def test_no_cross_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_windows_are_partitioned(plans):
    """A global window runs only over tables of splits, ranges or models."""
    for name, text in plans.items():
        for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
            first = window.split(",")[0]
            assert "ASC" not in first and "DESC" not in first or "_range" in first, (name, window)


def test_pair_statistics_scan_and_shuffle_once(spark, data):
    text = plan(pairs.pair_stats(inputs.predictions(spark, data)))
    assert text.count("Exchange") == 1 and "partial_count" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_partkey", "l_suppkey", "l_quantity"}


def test_filters_reach_the_scan(spark, data, settings):
    settings(maxMetadataStringLength="2000")
    text = plan(agreement.positive_intersection(
        spark.read.parquet(f"{data}/lineitem.parquet").select(
            F.col("l_linestatus").alias("model_type"), F.col("l_linenumber").cast("string").alias("model_name"),
            F.col("l_suppkey").alias("protein_id"), F.col("l_partkey").alias("compound_id"),
            F.col("l_quantity").alias("prediction"),
        ), ("O", "1"), ("F", "2")))
    assert "EqualTo(l_linestatus,O)" in text and "GreaterThanOrEqual(l_quantity,1.0)" in text


def test_top_k_is_limited_before_the_shuffle(spark, data):
    text = plan(consensus.top_by_strategy(pairs.pair_stats(inputs.predictions(spark, data)), P))
    assert text.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(
        consensus.top(pairs.pair_stats(inputs.predictions(spark, data)), "all_positive", P)
    )


def test_counts_need_one_pass(spark, data):
    stats = pairs.pair_stats(inputs.predictions(spark, data))
    for frame in (
        consensus.funnel(stats, P), consensus.threshold_sweep(stats, P), consensus.strategy_counts(stats, P),
    ):
        assert plan(frame).count("FileScan") == 1


def test_distributions_combine_before_the_shuffle(spark, data):
    """No exchange carries a row per pair: each stands on a partial aggregate, but for those of the pairs."""
    stats = stage(pairs.pair_stats(inputs.predictions(spark, data)), "stats")
    for frame in (
        distributions.histogram(stats), distributions.density(stats), distributions.distribution_stats(stats),
        distributions.box_stats(stats),
    ):
        text = plan(frame)
        for below in re.findall(r"Exchange hashpartitioning\(metric.*\n(.*)", text):
            assert "partial_" in below or "functions=[]" in below, text


def test_first_rows_are_found_by_hash(spark, data):
    text = plan(entities.unique_proteins(inputs.interactions(spark, data)))
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_sequences_stay_out_of_the_row_shuffles(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    rows = spark.createDataFrame(
        [(1, "P", "SEQ", "C", "S", "")],
        "row_no long, accession string, sequence string, compound_cid string, smile string, label string",
    )
    proteins = spark.createDataFrame([], "accession string, sequence_length long, pssm_available boolean, sequence_vector array<double>, profile_vector array<double>")
    molecules = spark.createDataFrame([], "compound_cid string, compound_vector array<double>")
    full = assemble.assemble(rows, proteins, molecules)
    assert "sequence" not in full.columns
    text = plan(full.select(assemble.combined_columns()))
    before, after = text.split("Exchange hashpartitioning(compound_cid", 1)
    assert "length(sequence" not in before and "length(sequence" in after


def _skew(settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="64k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )


def test_hot_protein_is_split_when_features_are_attached(spark, settings):
    """A third of the rows share one protein."""
    _skew(settings)
    rows = spark.range(0, 60_000, 1, 6).select(
        (F.col("id") + 1).alias("row_no"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("P"), F.col("id"))).alias("accession"),
        F.lit("ACD").alias("sequence"),
        F.sha2(F.col("id").cast("string"), 256).alias("smile"),
    )
    unique = entities.unique_proteins(rows)
    features = assemble.protein_features(
        sequences.sequence_features(unique.filter("accession = 'hot'")),
        spark.createDataFrame([], "accession string, profile_vector array<double>"),
    )
    out = assemble.attach_proteins(assemble.with_own_length(rows), features).select(
        "accession", "smile", F.element_at("sequence_vector", 2).alias("a")
    )
    assert {r.accession for r in out.filter("a > 0").select("accession").distinct().collect()} == {"hot"}
    out.collect()
    assert "SortMergeJoin(skew=true)" in plan(out)
    assert out.filter("accession = 'hot'").count() == 20_000


def test_compound_vectors_are_not_broadcast_by_an_estimate(spark, tmp_path):
    """200,000 vectors (some 100 MB) pack into a file of few MB, so by Spark's estimate they are small."""
    spark.range(200_000).write.parquet(f"{tmp_path}/ids")
    features = spark.read.parquet(f"{tmp_path}/ids").select(
        F.concat(F.lit("C"), "id").alias("compound_cid"), F.array(*[F.col("id") * 1.0] * 64).alias("compound_vector")
    )
    rows = spark.range(1_000).select(
        (F.col("id") + 1).alias("row_no"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("C"), "id")).otherwise("").alias("compound_cid")
    )
    out = assemble.attach_compounds(rows, features)
    assert out.filter("compound_vector[63] = if(row_no % 2 = 1, row_no - 1, 0)").count() == out.count() == 1_000
    out.collect()
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)


def test_hot_pair_is_split_in_the_detailed_export(spark, settings):
    _skew(settings)
    i = F.col("id")
    predictions = spark.range(0, 60_000, 1, 6).select(
        F.lit("T").alias("model_type"),
        F.sha2(i.cast("string"), 256).alias("model_name"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("P"), F.floor(i / 6))).alias("protein_id"),
        F.lit("C").alias("compound_id"),
        F.lit(1).alias("prediction"),
        F.lit(0.1).alias("probability_0"),
        F.lit(0.9).alias("probability_1"),
        F.lit(0.9).alias("confidence"),
    )
    detail = tables.export_detailed(pairs.pair_stats(predictions), predictions, P)
    rows = detail.groupBy("strategy").count().collect()
    assert {r.strategy: r["count"] for r in rows} == {n: 60_000 for n in consensus.scores()}
    detail.collect()
    assert "SortMergeJoin(skew=true)" in plan(detail)


def test_detailed_export_carries_strategies_as_bits(plans):
    """Nothing interpreted for each pair or row, and no list of names in the join."""
    text = plans["export_detailed"]
    assert "lambda" not in text and "all_positive, score" not in text
    joined = text[text.index("SortMergeJoin"):] if "SortMergeJoin" in text else text[text.index("BroadcastHashJoin"):]
    assert "strategy" not in joined


def test_long_profile_spreads_over_window_groups(spark):
    rows = spark.range(1, 5001).select(
        F.concat(F.lit("P"), F.col("id") - F.col("id")).alias("accession"), F.col("id").alias("pos"),
        F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(20)]).alias("scores"),
    )
    text = plan(profiles.profile_lag_means(rows))
    assert re.search(r"hashpartitioning\(accession#\d+, _block#\d+L", text)
    means = {r.lag: r.means for r in profiles.profile_lag_means(rows).collect()}
    want = rows.alias("a").join(rows.alias("b"), F.expr("b.pos = a.pos + 7")).agg(
        F.avg(F.pow(F.expr("a.scores[4] - b.scores[4]"), 2))
    ).first()[0]
    assert means[7][4] == pytest.approx(want)


def test_only_rows_that_may_be_first_are_shuffled(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    n, entities_ = 200_000, 3_000
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") * 7919 % entities_).cast("string"))
    rows = stage(spark.range(n).select((F.col("id") + 1).alias("row_no"), key.alias("k"),
                                       F.concat(F.lit("v"), "id").alias("v")), "rows")
    found = entities.filtered_first_occurrence(rows, "k", "v", (0, 10_000))
    text = plan(found)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text
    plainly = entities.filtered_first_occurrence(rows, "k", "v", (10, 11))
    assert "BroadcastHashJoin" not in plan(plainly)
    assert sorted(map(str, found.collect())) == sorted(map(str, plainly.collect()))
    firsts = stage(rows.groupBy("k").agg(F.min("row_no").alias("first_row")), "firsts")
    wanted = firsts.count()
    passed = entities.may_be_first(rows, firsts, wanted)
    assert passed.join(firsts, passed["row_no"] == firsts["first_row"]).count() == wanted
    assert passed.count() < wanted + n // 100


def test_first_rows_of_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "row_no bigint, k string, v string")
    assert entities.filtered_first_occurrence(empty, "k", "v", (0, 10)).count() == 0
    rows = spark.createDataFrame([(2, "a", "y"), (1, "a", None), (4, "", "z"), (3, None, "n"), (5, None, "m"), (6, "", "")],
                                 "row_no bigint, k string, v string")
    for filtered in ((0, 10), (10, 20)):
        got = {tuple(r) for r in entities.filtered_first_occurrence(rows, "k", "v", filtered).collect()}
        assert got == {("a", None, 1), ("", "z", 4), (None, "n", 3)}
