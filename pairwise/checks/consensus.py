"""Registered consensus queries with their SQL counterparts."""

from pyspark.sql import functions as F

from pairwise.checks import inputs
from pairwise.constants import (
    NEGATIVE_LABEL,
    POSITIVE_LABEL,
    PRESETS,
    STRATEGIES,
)
from pairwise.functions.scalar import rounded_to
from pairwise.operators import agreement, consensus, distributions, pairs, sweeps
from pairwise.params import ConsensusParams, sweep_thresholds
from pairwise.session import hadoop_path, stage, staging_path, unsorted_writes
from pairwise.sinks import files, tables
from pairwise.sinks.report import report
from pairwise.sources import predictions as sources
from pairwise.sources import runs
from pairwise.sources.listing import find_files

P = ConsensusParams()
DIGITS = 6


def rounded(df, exact=frozenset()):
    """Doubles to six places, as in the SQL, but for those that both engines compute exactly."""
    fields = [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() == "double" and f.name not in exact
    ]
    return df.withColumns({name: F.expr(f"round(`{name}`, {DIGITS})") for name in fields})


def counts_long(df):
    """Integers as BIGINT, as in the SQL."""
    fields = [f.name for f in df.schema.fields if f.dataType.typeName() == "integer"]
    return df.withColumns({name: F.col(name).cast("long") for name in fields})


def tidy(df, exact=frozenset()):
    return rounded(counts_long(df), exact)


def stats(spark, d):
    return pairs.pair_stats(inputs.predictions(spark, d))


def staged_stats(spark, d):
    """Pair statistics for queries that read them several times."""
    return stage(stats(spark, d), "pair-stats")


STATS = f"""WITH {inputs.PREDICTIONS},
counted AS (
  SELECT protein_id, compound_id, count(*) AS total_models,
         count(*) FILTER (WHERE prediction = 1) AS positive_predictions,
         round(avg(probability_1), 12) AS avg_probability_1,
         round(avg(confidence), 12) AS avg_confidence
  FROM fx_predictions GROUP BY protein_id, compound_id),
stats AS (
  SELECT *, total_models - positive_predictions AS negative_predictions,
         positive_predictions / total_models AS positive_ratio,
         1 - avg_probability_1 AS avg_probability_0
  FROM counted)"""

CONDITIONS = {
    "all_positive": "total_models >= 2 AND positive_predictions = total_models",
    "majority_positive": "total_models >= 2 AND positive_predictions >= 2 AND positive_ratio > 0.5",
    "high_confidence": "total_models >= 2 AND positive_predictions >= 2 AND avg_confidence >= 0.7",
    "high_probability": "total_models >= 2 AND positive_predictions >= 2 AND avg_probability_1 >= 0.6",
    "custom_consensus": "total_models >= 2 AND positive_predictions >= 2 AND avg_confidence >= 0.7 "
    "AND avg_probability_1 >= 0.6",
}
SCORES = {
    "all_positive": "avg_confidence",
    "majority_positive": "avg_confidence",
    "high_confidence": "avg_confidence",
    "high_probability": "avg_probability_1",
    "custom_consensus": "(avg_confidence + avg_probability_1) / 2",
}
SUMMARY_SQL = """protein_id, compound_id, total_models, positive_predictions, negative_predictions,
  round(positive_ratio, 6) AS positive_ratio, round(avg_probability_0, 6) AS avg_probability_0,
  round(avg_probability_1, 6) AS avg_probability_1, round(avg_confidence, 6) AS avg_confidence"""

MEMBERS = (
    STATS
    + ",\nmembers AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, {SCORES[n]} AS score, * FROM stats WHERE {CONDITIONS[n]}"
        for n in STRATEGIES
    )
    + ")"
)
RANKED = (
    MEMBERS
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY strategy
                               ORDER BY score DESC, protein_id, compound_id) AS rank
  FROM members)"""
)
METRICS = (
    STATS
    + """,
metrics AS (
  SELECT 'probability' AS metric, round(avg_probability_1, 12) AS value FROM stats
  UNION ALL SELECT 'confidence', round(avg_confidence, 12) FROM stats
  UNION ALL SELECT 'ratio', round(positive_ratio, 12) FROM stats)"""
)

QUERIES = {}
SQL = {}


def register(name, sql):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


# ---- pair statistics ---------------------------------------------------------------------------


@register("pair_stats", f"{STATS} SELECT {SUMMARY_SQL} FROM stats")
def _pair_stats(spark, d):
    return tidy(stats(spark, d))


@register(
    "pair_key",
    f"""WITH {inputs.PREDICTIONS},
keyed AS (SELECT concat(protein_id, '_', model_name, '_', compound_id) AS pair_key, *
          FROM fx_predictions)
SELECT split_part(pair_key, '_', 1) AS protein_id,
       substr(pair_key, instr(pair_key, '_') + 1) AS compound_id,
       count(*) AS total_models, count(*) FILTER (WHERE prediction = 1) AS positive_predictions,
       round(round(avg(probability_1), 12), 6) AS avg_probability_1,
       round(round(avg(confidence), 12), 6) AS avg_confidence
FROM keyed GROUP BY 1, 2""",
)
def _pair_key(spark, d):
    joined = F.concat_ws("_", "protein_id", "model_name")
    frame = inputs.predictions(spark, d).withColumn("protein_id", joined)
    return tidy(pairs.pair_stats(frame, legacy_key=True)).drop(
        "negative_predictions", "positive_ratio", "avg_probability_0"
    )


@register(
    "prediction_defaults",
    f"""WITH {inputs.PREDICTIONS}
SELECT protein_id, compound_id, count(*) AS n, round(sum(probability_0), 6) AS probability_0,
       round(sum(probability_1), 6) AS probability_1, round(sum(0.5::DOUBLE), 6) AS confidence
FROM fx_predictions GROUP BY protein_id, compound_id""",
)
def _prediction_defaults(spark, d):
    frame = sources.with_defaults(inputs.predictions(spark, d).drop("confidence"))
    sums = [F.sum(c).alias(c) for c in sources.DEFAULTED]
    return tidy(frame.groupBy(*pairs.PAIR).agg(F.count("*").alias("n"), *sums))


def _model_tables(spark, d):
    """Two model tables with unlike headers: one lacks a column, the other has them reordered."""
    frame = inputs.predictions(spark, d)
    open_models = frame.filter("model_type = 'MO'").drop("confidence")
    finished = frame.filter("model_type = 'MF'")
    return [open_models, finished.select(*reversed(finished.columns))]


@register(
    "predictions_union",
    f"""WITH {inputs.PREDICTIONS}
SELECT model_type, model_name, protein_id, compound_id, prediction,
       round(probability_0, 6) AS probability_0, round(probability_1, 6) AS probability_1,
       CASE WHEN model_type = 'MF' THEN round(confidence, 6) END AS confidence
FROM fx_predictions""",
)
def _predictions_union(spark, d):
    return rounded(sources.union_models(_model_tables(spark, d)))


@register(
    "export_models",
    f"""WITH {inputs.PREDICTIONS}
SELECT concat('a_', model_type) AS model_type, model_name, protein_id, compound_id,
       round(probability_1, 6) AS probability_1,
       CASE WHEN model_type = 'MF' THEN round(confidence, 6) END AS confidence
FROM fx_predictions""",
)
def _export_models(spark, d):
    """The complete export of two file formats, as it is written and read back."""
    path = staging_path(spark, "models")
    raw = []
    for frame in _model_tables(spark, d):
        named = frame.withColumn("model_type", F.concat(F.lit("a/"), "model_type"))
        raw.append(named.select(*[F.col(c).cast("string") for c in frame.columns]))
    frame = inputs.predictions(spark, d)
    files.write_models(raw, sources.union_models(raw), pairs.pair_stats(frame), P, path)
    columns = ["model_type", "model_name", "protein_id", "compound_id", "probability_1", "confidence"]
    written = [spark.read.option("header", True).csv(f"{path}/models/format-{i}") for i in range(len(raw))]
    found = sources.union_models(written).select(columns)
    numbers = {c: F.col(c).cast("double") for c in ("probability_1", "confidence")}
    return rounded(found.withColumns(numbers))


def _written_run(spark, d):
    """A run folder with a file for each model, written from the predictions."""
    frame = inputs.predictions(spark, d).drop("probability_0")
    run = f"{staging_path(spark, 'run')}/batch_prediction_1"
    with_folders = frame.withColumns(
        {"_folder": F.col("model_type"), "_file": F.concat("model_name", F.lit("_prediction.csv"))}
    )
    target = f"{run}/parts"
    dealt = with_folders.repartition("_folder", "_file").drop("model_type", "model_name")
    with unsorted_writes(spark):  # a model's file is written by one task, however long it is
        files.write_csv(dealt, target, ("_folder", "_file"))
    # one part file for each model: give it the name that a run has
    for part in find_files(spark, f"{target}/*/*/part-*"):
        *_, folder, name, _ = part.split("/")
        disk, at = hadoop_path(spark, part)
        to = hadoop_path(spark, f"{run}/{folder.split('=')[1]}/{name.split('=')[1]}")[1]
        disk.mkdirs(to.getParent())
        disk.rename(at, to)
    return run


@register(
    "prediction_files",
    f"""WITH {inputs.PREDICTIONS}
SELECT model_type, model_name, protein_id, compound_id, prediction::DOUBLE AS prediction, 0.5::DOUBLE AS probability_0,
       round(probability_1, 6) AS probability_1, round(confidence, 6) AS confidence
FROM fx_predictions""",
)
def _prediction_files(spark, d):
    """The run read back."""
    return rounded(sources.read_predictions(spark, _written_run(spark, d)))


@register(
    "discovered_files",
    f"""WITH {inputs.PREDICTIONS}
SELECT model_type AS model_dir, model_name, 'protein_id,compound_id,prediction,probability_1,confidence' AS header,
       count(*) AS records
FROM fx_predictions GROUP BY model_type, model_name""",
)
def _discovered_files(spark, d):
    """The catalogue of a written run, with the records that stand below each header."""
    run = _written_run(spark, d)
    listed = runs.discovered_models(spark, run).select("model_dir", "model_name", F.array_join("header", ",").alias("header"))
    read = sources.union_models(sources.read_raw_models(spark, run))
    counted = read.groupBy(F.col("model_type").alias("model_dir"), "model_name").agg(F.count("*").alias("records"))
    return listed.join(counted, ["model_dir", "model_name"])


@register(
    "run_catalogue",
    """WITH counted AS (
  SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS done
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT concat(source, '_features_', total) AS run_dir,
       CASE WHEN done * 2 > total THEN 'complete' ELSE 'incomplete' END AS status,
       done AS proteins_processed, total AS total_proteins, 0::BIGINT AS compounds_processed, total AS total_compounds
FROM counted ORDER BY run_dir""",
)
def _run_catalogue(spark, d):
    """A folder for each source of the documents, with a record of its progress, and the catalogue of these."""
    docs, labels = inputs.table(spark, d, "documents"), inputs.table(spark, d, "labels")
    counted = docs.join(labels, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("total_proteins"), F.count_if(F.col("quality") == 1).alias("proteins_processed")
    )
    fields = {
        "total_compounds": F.col("total_proteins"),
        "completed": F.col("proteins_processed") * 2 > F.col("total_proteins"),
    }
    records = counted.withColumns(fields)
    run = F.concat("source", F.lit("_features_"), F.col("total_proteins").cast("string")).alias("run")
    top = staging_path(spark, "catalogue")
    body = F.to_json(F.struct(*[c for c in records.columns if c != "source"])).alias("value")
    records.select(run, body).repartition("run").write.partitionBy("run").text(f"{top}/parts")
    # one part file for each run: give it the name that a run has
    for part in find_files(spark, f"{top}/parts/*/part-*"):
        disk, at = hadoop_path(spark, part)
        to = hadoop_path(spark, f"{top}/{part.split('/')[-2].removeprefix('run=')}/progress.json")[1]
        disk.mkdirs(to.getParent())
        disk.rename(at, to)
    return runs.resumable_runs(spark, top)


@register(
    "export_totals",
    f"""WITH {inputs.PREDICTIONS}
SELECT count(DISTINCT (model_type, model_name)) AS models, count(*) AS records
FROM fx_predictions""",
)
def _export_totals(spark, d):
    return pairs.export_totals(inputs.predictions(spark, d))


@register(
    "model_inventory",
    f"""WITH {inputs.PREDICTIONS}
SELECT model_type, count(DISTINCT model_name) AS models,
       string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS model_names
FROM fx_predictions GROUP BY model_type""",
)
def _model_inventory(spark, d):
    return pairs.model_inventory(inputs.predictions(spark, d))


@register(
    "model_short_names",
    f"""WITH {inputs.PREDICTIONS}
SELECT DISTINCT concat('net_', model_type, '_large') AS model_type,
       concat(model_name, '_v1') AS model_name,
       concat('lar', '_', substr(concat(model_name, '_v1'), 1, 3)) AS short_name
FROM fx_predictions""",
)
def _model_short_names(spark, d):
    frame = inputs.predictions(spark, d).select(
        F.concat(F.lit("net_"), "model_type", F.lit("_large")).alias("model_type"),
        F.concat("model_name", F.lit("_v1")).alias("model_name"),
    )
    return pairs.with_short_names(pairs.model_list(frame)).drop("model")


@register(
    "summary_models",
    """SELECT DISTINCT concat('M/', l_linestatus) AS model_type,
       concat('m', l_linenumber) AS model_name, concat('M_', l_linestatus) AS model_dir
FROM lineitem""",
)
def _summary_models(spark, d):
    listed = inputs.predictions(spark, d).select(
        F.concat(F.lit("M/"), F.substring("model_type", 2, 1)).alias("model_type"),
        "model_name",
        F.concat(F.lit("M_"), F.substring("model_type", 2, 1)).alias("model_dir"),
    ).distinct()
    # the summary text: one small document, one entry per model
    inner = listed.groupBy("model_type").agg(
        F.map_from_entries(
            F.collect_list(F.struct("model_name", F.lit(0.9).alias("score")))
        ).alias("models")
    )
    text = inner.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("model_type", "models")))).alias("text")
    )
    files = listed.select("model_dir", "model_name")
    return runs.summary_models(text, "text").join(files, ["model_dir", "model_name"])


@register(
    "latest_run",
    """SELECT max(run) AS latest_run FROM (
  SELECT concat(CASE WHEN o_orderstatus = 'O' THEN 'draft_' ELSE 'batch_prediction_' END,
                strftime(o_orderdate, '%Y%m%d_%H%M%S')) AS run FROM orders)
WHERE starts_with(run, 'batch_prediction_')""",
)
def _latest_run(spark, d):
    prefix = F.when(F.col("o_orderstatus") == "O", "draft_").otherwise(runs.RUN_PREFIX)
    name = F.concat(prefix, F.date_format("o_orderdate", "yyyyMMdd_HHmmss"))
    return runs.latest_of(inputs.table(spark, d, "orders").select(name.alias("run")), "run")


# ---- strategies --------------------------------------------------------------------------------


def _strategy(name):
    sql = f"{STATS} SELECT {SUMMARY_SQL}, round({SCORES[name]}, 6) AS score FROM stats WHERE {CONDITIONS[name]}"

    @register(name, sql)
    def run(spark, d):
        return rounded(consensus.select_strategy(stats(spark, d), name, P))


for _name in STRATEGIES:
    _strategy(_name)


@register(
    "topk_by_strategy",
    f"{RANKED} SELECT strategy, rank, {SUMMARY_SQL}, round(score, 6) AS score FROM ranked WHERE rank <= 20",
)
def _topk_by_strategy(spark, d):
    return tidy(consensus.top_by_strategy(stats(spark, d), P, 20))


@register(
    "topk_custom",
    f"""{STATS} SELECT {SUMMARY_SQL}, round({SCORES['custom_consensus']}, 6) AS score FROM stats
WHERE {CONDITIONS['custom_consensus']}
ORDER BY {SCORES['custom_consensus']} DESC, protein_id, compound_id LIMIT 20""",
)
def _topk_custom(spark, d):
    return tidy(consensus.top(stats(spark, d), "custom_consensus", P, 20))


@register(
    "strategy_counts",
    f"{STATS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, count(*) AS pairs FROM stats WHERE {CONDITIONS[n]}"
        for n in STRATEGIES
    ),
)
def _strategy_counts(spark, d):
    return consensus.strategy_counts(stats(spark, d), P)


@register(
    "preset_comparison",
    f"{STATS} "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS preset, {p}::DOUBLE AS probability, {c}::DOUBLE AS confidence,
  count(*) AS pairs FROM stats WHERE total_models >= 2 AND positive_predictions >= 2
  AND avg_confidence >= {c} AND avg_probability_1 >= {p}"""
        for n, (p, c) in PRESETS.items()
    ),
)
def _preset_comparison(spark, d):
    return consensus.preset_comparison(stats(spark, d))


@register(
    "threshold_counts",
    f"""{STATS} SELECT count(*) FILTER (avg_probability_1 >= 0.6) AS over_probability,
  count(*) FILTER (avg_confidence >= 0.7) AS over_confidence,
  count(*) FILTER (avg_probability_1 >= 0.6 AND avg_confidence >= 0.7) AS over_both FROM stats""",
)
def _threshold_counts(spark, d):
    return consensus.threshold_counts(stats(spark, d), P)


@register(
    "threshold_sweep",
    f"""{STATS}, t(threshold) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in sweep_thresholds())}),
m AS (SELECT 'probability' AS metric, positive_predictions AS n, avg_probability_1 AS v FROM stats
      UNION ALL SELECT 'confidence', positive_predictions, avg_confidence FROM stats)
SELECT metric, threshold, count(*) FILTER (n >= 2 AND v >= threshold) AS pairs
FROM m CROSS JOIN t GROUP BY metric, threshold""",
)
def _threshold_sweep(spark, d):
    return consensus.threshold_sweep(stats(spark, d), P)


_GRID = [round(i / 50, 2) for i in range(51)]


@register(
    "threshold_grid",
    f"""{STATS}, p(probability) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in _GRID)}),
c(confidence) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in _GRID)}), k(positives) AS (VALUES (0), (2), (4)),
v AS (SELECT avg_probability_1 AS x, avg_confidence AS y, positive_predictions AS n, count(*) AS pairs FROM stats GROUP BY ALL)
SELECT probability, confidence, positives,
       CAST(coalesce(sum(pairs) FILTER (x >= probability AND y >= confidence AND n >= positives), 0) AS BIGINT) AS pairs
FROM v, p, c, k GROUP BY ALL""",
)
def _threshold_grid(spark, d):
    """Pairs over every combination of 51 x 51 thresholds and three numbers of positives."""
    return sweeps.threshold_grid(stats(spark, d), _GRID, _GRID, [0, 2, 4])


_FUNNEL = {
    "total": "true",
    "one_positive": "positive_predictions > 0",
    "two_positives": "positive_predictions >= 2",
    **{n: CONDITIONS[n] for n in ("majority_positive", "high_probability", "high_confidence",
                                  "all_positive", "custom_consensus")},
}


@register(
    "funnel",
    f"{STATS} "
    + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS stage, '{n}' AS name, count(*) AS pairs FROM stats WHERE {c}"
        for i, (n, c) in enumerate(_FUNNEL.items(), start=1)
    ),
)
def _funnel(spark, d):
    return tidy(consensus.funnel(stats(spark, d), P))


_SIZES = f"""{STATS}, sizes AS (
  SELECT count(*) FILTER ({CONDITIONS['all_positive']}) AS a,
         count(*) FILTER ({CONDITIONS['high_confidence']}) AS h,
         count(*) FILTER ({CONDITIONS['majority_positive']}) AS m FROM stats)"""
_ADVICE = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS rule, '{code}' AS code, '{text}' AS advice FROM sizes WHERE {test}"
    for i, ((code, text), test) in enumerate(zip(consensus.ADVICE, ["a > 0", "h > a", "m > 50"]), start=1)
)


@register("advice_rules", f"{_SIZES} {_ADVICE}")
def _advice_rules(spark, d):
    return tidy(consensus.advice(stats(spark, d), P))


# ---- distributions -----------------------------------------------------------------------------


@register(
    "distribution_stats",
    f"""{METRICS} SELECT metric, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max FROM metrics GROUP BY metric""",
)
def _distribution_stats(spark, d):
    return tidy(distributions.distribution_stats(staged_stats(spark, d)))


def _share_sql(label, groups):
    return f"{STATS} " + " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS position, '{text}' AS {label}, count(*) FILTER ({test}) AS pairs,
  round(count(*) FILTER ({test}) * 100.0::DOUBLE / count(*), 6) AS percent FROM stats"""
        for i, (text, test) in enumerate(groups, start=1)
    )


@register(
    "ratio_groups",
    _share_sql(
        "ratio_group",
        [
            ("0", "positive_ratio = 0"),
            ("(0,0.25]", "positive_ratio > 0 AND positive_ratio <= 0.25"),
            ("(0.25,0.5]", "positive_ratio > 0.25 AND positive_ratio <= 0.5"),
            ("(0.5,0.75]", "positive_ratio > 0.5 AND positive_ratio <= 0.75"),
            ("(0.75,1)", "positive_ratio > 0.75 AND positive_ratio < 1"),
            ("1", "positive_ratio = 1"),
        ],
    ),
)
def _ratio_groups(spark, d):
    return tidy(distributions.ratio_groups(stats(spark, d)))


@register(
    "ratio_bins",
    _share_sql(
        "ratio_bin",
        [
            ("0-25%", "positive_ratio < 0.25"),
            ("25-50%", "positive_ratio >= 0.25 AND positive_ratio < 0.5"),
            ("50-75%", "positive_ratio >= 0.5 AND positive_ratio < 0.75"),
            ("75-100%", "positive_ratio >= 0.75"),
        ],
    ),
)
def _ratio_bins(spark, d):
    return tidy(distributions.ratio_bins(stats(spark, d)))


def _histogram_sql(bins, metrics, measure):
    kept = ", ".join(f"'{m}'" for m in metrics)
    return f"""{METRICS},
spans AS (
  SELECT metric, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / {bins} AS width,
         count(*) AS total FROM metrics WHERE metric IN ({kept}) GROUP BY metric),
binned AS (
  SELECT metric, len(list_filter(range(1, {bins}), lambda i: value >= lo + width * i)) AS bin
  FROM metrics JOIN spans USING (metric)),
counts AS (SELECT metric, bin, count(*) AS pairs FROM binned GROUP BY metric, bin)
SELECT s.metric, b.bin, round(lo + width * b.bin, 6) AS bin_start,
       round(CASE WHEN b.bin = {bins} - 1 THEN hi ELSE lo + width * (b.bin + 1) END, 6) AS bin_end,
       {measure}
FROM spans s CROSS JOIN range({bins}) AS b(bin)
LEFT JOIN counts c ON c.metric = s.metric AND c.bin = b.bin"""


@register(
    "histogram20",
    _histogram_sql(20, distributions.METRICS, "coalesce(pairs, 0) AS pairs"),
)
def _histogram20(spark, d):
    return tidy(distributions.histogram(staged_stats(spark, d), 20)).drop("density")


@register(
    "density30",
    _histogram_sql(
        30, ("probability", "confidence"), "round(coalesce(pairs, 0) / (total * width), 6) AS density"
    ),
)
def _density30(spark, d):
    return tidy(distributions.density(staged_stats(spark, d), 30))


@register(
    "box_stats",
    f"""{METRICS},
q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM metrics GROUP BY metric),
f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS low, q3 + (q3 - q1) * 1.5 AS high FROM q)
SELECT metric, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3,
       round(least(min(value) FILTER (value >= low), any_value(q1)), 6) AS whisker_low,
       round(greatest(max(value) FILTER (value <= high), any_value(q3)), 6) AS whisker_high,
       count(*) FILTER (value < low OR value > high) AS outliers
FROM metrics JOIN f USING (metric) GROUP BY metric""",
)
def _box_stats(spark, d):
    return tidy(distributions.box_stats(staged_stats(spark, d)))


@register(
    "scatter_series",
    f"""{STATS} SELECT protein_id, compound_id, round(avg_probability_1, 6) AS avg_probability_1,
  round(avg_confidence, 6) AS avg_confidence, round(positive_ratio, 6) AS positive_ratio FROM stats""",
)
def _scatter_series(spark, d):
    return tidy(distributions.scatter(stats(spark, d)))


# ---- agreement ---------------------------------------------------------------------------------

POSITIVES = f"""WITH {inputs.PREDICTIONS},
pos AS (SELECT DISTINCT model_type, model_name, protein_id, compound_id FROM fx_predictions
        WHERE CAST(trunc(prediction) AS INT) = 1)"""
JACCARD = f"""{POSITIVES},
models AS (
  SELECT model_type, model_name, concat(model_type, '_', model_name) AS model,
         row_number() OVER (ORDER BY model_type, model_name) - 1 AS i
  FROM (SELECT DISTINCT model_type, model_name FROM fx_predictions)),
hits AS (SELECT i, protein_id, compound_id FROM pos JOIN models USING (model_type, model_name)),
sizes AS (SELECT i, count(*) AS n FROM hits GROUP BY i),
inter AS (
  SELECT x.i AS a, y.i AS b, count(*) AS shared FROM hits x JOIN hits y
  USING (protein_id, compound_id) GROUP BY x.i, y.i),
cells AS (
  SELECT p.i AS a, q.i AS b, p.model AS model_a, q.model AS model_b,
         coalesce(shared, 0) AS shared, coalesce(sa.n, 0) AS na, coalesce(sb.n, 0) AS nb
  FROM models p CROSS JOIN models q
  LEFT JOIN inter ON inter.a = p.i AND inter.b = q.i
  LEFT JOIN sizes sa ON sa.i = p.i LEFT JOIN sizes sb ON sb.i = q.i),
matrix AS (
  SELECT a, b, model_a, model_b, shared, na + nb - shared AS union_size,
         CASE WHEN a = b THEN 1.0::DOUBLE WHEN na + nb - shared = 0 THEN 0.0::DOUBLE
              ELSE shared::DOUBLE / (na + nb - shared) END AS jaccard,
         CASE WHEN na = 0 THEN 0.0::DOUBLE ELSE shared::DOUBLE / na END AS coverage_a,
         CASE WHEN nb = 0 THEN 0.0::DOUBLE ELSE shared::DOUBLE / nb END AS coverage_b
  FROM cells)"""


@register("model_positive_sets", f"{POSITIVES} SELECT * FROM pos")
def _model_positive_sets(spark, d):
    return agreement.positives(inputs.predictions(spark, d))


@register(
    "model_positive_rate",
    f"""{POSITIVES}, n AS (SELECT model_type, model_name, count(*) AS predictions
                          FROM fx_predictions GROUP BY 1, 2),
h AS (SELECT model_type, model_name, count(*) AS positive_pairs FROM pos GROUP BY 1, 2)
SELECT n.model_type, n.model_name, predictions, coalesce(positive_pairs, 0) AS positive_pairs,
       round(coalesce(positive_pairs, 0) * 100.0::DOUBLE / predictions, 6) AS positive_rate
FROM n LEFT JOIN h USING (model_type, model_name)""",
)
def _model_positive_rate(spark, d):
    return tidy(agreement.positive_rates(inputs.predictions(spark, d)))


FIRST, SECOND = ("MF", "m1"), ("MO", "m2")


def _two_sets(operator):
    return f"""{POSITIVES}
SELECT protein_id, compound_id FROM pos WHERE model_type = 'MF' AND model_name = 'm1'
{operator}
SELECT protein_id, compound_id FROM pos WHERE model_type = 'MO' AND model_name = 'm2'"""


@register("positive_intersection", _two_sets("INTERSECT"))
def _positive_intersection(spark, d):
    return agreement.positive_intersection(inputs.predictions(spark, d), FIRST, SECOND)


@register("positive_union", _two_sets("UNION"))
def _positive_union(spark, d):
    return agreement.positive_union(inputs.predictions(spark, d), FIRST, SECOND)


def _matrix(spark, d):
    return agreement.jaccard(inputs.predictions(spark, d))


@register(
    "model_jaccard",
    f"""{JACCARD} SELECT a, b, model_a, model_b, shared, union_size, round(jaccard, 6) AS jaccard,
  round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b FROM matrix""",
)
def _model_jaccard(spark, d):
    return tidy(_matrix(spark, d))


@register(
    "jaccard_summary",
    f"""{JACCARD} SELECT round(avg(jaccard), 6) AS mean_jaccard, round(min(jaccard), 6) AS min_jaccard,
  round(max(jaccard), 6) AS max_jaccard FROM matrix WHERE a <> b HAVING max(jaccard) > 0""",
)
def _jaccard_summary(spark, d):
    return tidy(agreement.jaccard_summary(_matrix(spark, d)))


@register(
    "jaccard_extremes",
    f"""{JACCARD},
off AS (SELECT * FROM matrix WHERE a <> b AND (SELECT max(jaccard) FROM matrix WHERE a <> b) > 0)
(SELECT 'most' AS kind, model_a, model_b, round(jaccard, 6) AS jaccard FROM off
 ORDER BY off.jaccard DESC, a, b LIMIT 1)
UNION ALL
(SELECT 'least', model_a, model_b, round(jaccard, 6) FROM off ORDER BY off.jaccard, a, b LIMIT 1)""",
)
def _jaccard_extremes(spark, d):
    return tidy(agreement.jaccard_extremes(_matrix(spark, d)))


@register(
    "model_complementarity",
    f"""{JACCARD}, m AS (
  SELECT model_a AS model, round(avg(jaccard), 12) AS s FROM matrix WHERE a <> b
    AND (SELECT max(jaccard) FROM matrix WHERE a <> b) > 0 GROUP BY a, model_a)
SELECT model, round(s, 6) AS mean_similarity,
       CASE WHEN s < 0.5 THEN 'keep' WHEN s > 0.8 THEN 'redundant' ELSE 'suitable' END AS verdict
FROM m""",
)
def _model_complementarity(spark, d):
    return tidy(agreement.complementarity(_matrix(spark, d)))


# ---- exports -----------------------------------------------------------------------------------


@register(
    "export_basic", f"{MEMBERS} SELECT strategy, round(score, 6) AS score, {SUMMARY_SQL} FROM members"
)
def _export_basic(spark, d):
    return tidy(tables.export_basic(stats(spark, d), P))


@register(
    "export_detailed",
    f"""{MEMBERS} SELECT strategy, round(score, 6) AS score, m.protein_id, m.compound_id, model_type,
  model_name, prediction::BIGINT AS prediction,
  CASE WHEN prediction = 1 THEN '{POSITIVE_LABEL}' ELSE '{NEGATIVE_LABEL}' END AS prediction_label,
  round(probability_0, 6) AS probability_0, round(probability_1, 6) AS probability_1,
  round(confidence, 6) AS confidence, round(avg_probability_1, 6) AS avg_probability_1,
  round(avg_confidence, 6) AS avg_confidence, round(positive_ratio, 6) AS positive_ratio
FROM members m JOIN fx_predictions p USING (protein_id, compound_id)""",
)
def _export_detailed(spark, d):
    frame = inputs.predictions(spark, d)
    rows = counts_long(tables.export_detailed(pairs.pair_stats(frame), frame, P))
    doubles = [name for name, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({name: rounded_to(F.col(name), DIGITS) for name in doubles})


@register(
    "export_parameters",
    f"""{STATS} SELECT 'basic' AS export_type, 2::BIGINT AS min_consensus_models,
  0.6::DOUBLE AS probability_threshold, 0.7::DOUBLE AS confidence_threshold,
  (SELECT count(*) FROM stats) AS total_compounds_analyzed,
  (SELECT count(DISTINCT (model_type, model_name)) FROM fx_predictions) AS total_models""",
)
def _export_parameters(spark, d):
    frame = inputs.predictions(spark, d)
    return tidy(tables.export_parameters(pairs.pair_stats(frame), frame, P, "basic"))


# --- fixed values: meaning of the columns of the full export, as SQL states them -------------------
MEANINGS = {
    "model_type": "model type",
    "model_name": "model name",
    "protein_id": "protein id",
    "compound_id": "compound id",
    "prediction": "predicted class (0 no interaction, 1 interaction)",
    "probability_0": "probability of no interaction",
    "probability_1": "probability of interaction",
    "confidence": "confidence of the prediction",
}
# --------------------------------------------------------------------------------------------------


@register(
    "column_dictionary",
    f"WITH {inputs.PREDICTIONS}, everything AS (SELECT *, CASE WHEN model_type = 'MF' THEN confidence "
    "END AS cell FROM fx_predictions)\n"
    + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{text}' AS description, "
        f"count({'cell' if c == 'confidence' else c}) AS filled FROM everything"
        for i, (c, text) in enumerate(MEANINGS.items(), start=1)
    ),
)
def _column_dictionary(spark, d):
    """The meanings that the complete export writes, with the number of filled cells."""
    frame = sources.union_models(_model_tables(spark, d))
    counts = frame.agg(*[F.count(c).alias(c) for c in MEANINGS]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in MEANINGS]))
    )
    return tidy(tables.column_meanings(spark, frame.columns).join(counts, "column"))


def _report_sql():
    parts = [
        f"SELECT '2_strategies' AS section, {i}::BIGINT AS ord, '{n}' AS key, "
        f"count(*)::VARCHAR AS value FROM stats WHERE {CONDITIONS[n]}"
        for i, n in enumerate(STRATEGIES, start=1)
    ]
    overview = {
        "total_compounds_analyzed": "(SELECT count(*) FROM stats)::VARCHAR",
        "total_models": "(SELECT count(DISTINCT (model_type, model_name)) FROM fx_predictions)::VARCHAR",
        "min_consensus_models": "'2'",
        "probability_threshold": "'0.600'",
        "confidence_threshold": "'0.700'",
    }
    parts += [
        f"SELECT '1_overview', {i}, '{k}', {v}" for i, (k, v) in enumerate(overview.items(), start=1)
    ]
    # half-up decimals, as the JVM writes them
    text = "printf('%.{d}f', round({x} + 1e-12, {d}))".format
    parts += [
        f"SELECT '3_{n}', rank, rank::VARCHAR, concat(protein_id, '|', compound_id, '|', "
        f"{text(x='avg_probability_1', d=3)}, '|', {text(x='avg_confidence', d=3)}) "
        f"FROM ranked WHERE strategy = '{n}' AND rank <= 20"
        for n in ("all_positive", "high_confidence")
    ]
    figures = {
        "mean": "avg({c})",
        "median": "quantile_cont({c}, 0.5)",
        "std": "stddev_pop({c})",
        "min": "min({c})",
        "max": "max({c})",
    }
    for metric in ("probability", "confidence"):
        column = distributions.METRICS[metric]
        parts += [
            f"SELECT '4_{metric}', {i}, '{f}', {text(x=e.format(c=column), d=4)} FROM stats"
            for i, (f, e) in enumerate(figures.items(), start=1)
        ]
    sizes = _SIZES.split("sizes AS", 1)[1]
    advice = " UNION ALL ".join(
        f"SELECT '5_advice', {i}, '{code}', '{line}' FROM sizes WHERE {test}"
        for i, ((code, line), test) in enumerate(
            zip(consensus.ADVICE, ["a > 0", "h > a", "m > 50"]), start=1
        )
    )
    return f"{RANKED}, sizes AS {sizes} " + " UNION ALL ".join([*parts, advice])


@register("report_rows", _report_sql())
def _report_rows(spark, d):
    frame = inputs.predictions(spark, d)
    return tidy(report(stage(pairs.pair_stats(frame), "pair-stats"), frame, P))
