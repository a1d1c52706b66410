"""Registered feature queries with their SQL counterparts."""

from pyspark.sql import functions as F

from pairwise.checks import inputs
from pairwise.checks.consensus import tidy
from pairwise.constants import (
    DESCRIPTOR_GROUPS,
    DESCRIPTORS,
    MAX_LAG,
    PROPERTY_NAMES,
    RESIDUE_PROPERTIES,
    RESIDUES,
)
from pairwise.functions.names import compound_names, profile_names, sequence_names
from pairwise.operators import assemble, compounds, entities, ordinal, profiles, sequences
from pairwise.plans.features import feature_table
from pairwise.session import staging_path
from pairwise.sinks import files, tables
from pairwise.sources import interactions
from pairwise.sources.profiles import parse_profiles, with_profile_flag
from pairwise.sources.store import extend_store

QUERIES = {}
SQL = {}


def register(name, sql):
    def add(function):
        QUERIES[name] = function
        SQL[name] = sql
        return function

    return add


# ---- SQL building blocks -----------------------------------------------------------------------

ENTITIES = f"""WITH {inputs.INTERACTIONS},
proteins AS (
  SELECT accession, arg_min(sequence, row_no) AS sequence, min(row_no) AS first_row
  FROM fx_interactions GROUP BY accession),
compounds AS (
  SELECT compound_cid, arg_min(smile, row_no) AS smile, min(row_no) AS first_row
  FROM fx_interactions GROUP BY compound_cid)"""

# Residue properties in standard units, computed from the plain table by SQL.
_PROPERTIES = ", ".join(f"('{aa}', {', '.join(f'{v!r}::DOUBLE' for v in p)})" for aa, p in RESIDUE_PROPERTIES.items())
_Z = f"""properties(residue, a, b, c) AS (VALUES {_PROPERTIES}),
residues AS (
  SELECT residue, {', '.join(f'({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS p{i}' for i, x in enumerate('abc'))}
  FROM properties)"""
_P = ["p0", "p1", "p2"]
_LEADS = ", ".join(f"lead({p}, {lag}) OVER w AS {p}_{lag}" for p in _P for lag in range(1, MAX_LAG + 1))
_LAGS = ", ".join(
    f"coalesce(avg(({p} - {p}_{lag}) ** 2), 0.0::DOUBLE)" for p in _P for lag in range(1, MAX_LAG + 1)
)
_SHARES = ", ".join(
    f"CASE WHEN length(sequence) = 0 THEN 0.0::DOUBLE ELSE "
    f"(length(sequence) - length(replace(sequence, '{aa}', ''))) / length(sequence) END"
    for aa in RESIDUES
)
SEQUENCE = f"""{_Z},
letters AS (
  SELECT accession, unnest(string_split(sequence, '')) AS residue,
         generate_subscripts(string_split(sequence, ''), 1) AS pos
  FROM proteins WHERE sequence <> ''),
lagged AS (
  SELECT accession, p0, p1, p2, {_LEADS}
  FROM letters LEFT JOIN residues USING (residue)
  WINDOW w AS (PARTITION BY accession ORDER BY pos)),
lag_lists AS (SELECT accession, [{_LAGS}] AS lags FROM lagged GROUP BY accession),
sequence_features AS (
  SELECT accession, length(sequence) AS sequence_length,
         list_concat([length(sequence)::DOUBLE], [{_SHARES}],
                     coalesce(lags, list_resize([]::DOUBLE[], 30, 0.0::DOUBLE))) AS sequence_vector
  FROM proteins LEFT JOIN lag_lists USING (accession))"""

_COLS = range(1, 21)
_STATS = ", ".join(
    f"[{', '.join(f'{f}(scores[{i}])' for i in _COLS)}]" for f in ("avg", "stddev_pop", "max", "min")
)
_MEANS = ", ".join(f"avg((a.scores[{i}] - b.scores[{i}]) ** 2)" for i in _COLS)
PROFILE = f"""{inputs.PROFILE_ROWS},
profile_stats AS (
  SELECT accession, count(*) AS positions, list_concat({_STATS}) AS profile_stats
  FROM fx_profile GROUP BY accession),
lag_means AS (
  SELECT a.accession, b.pos - a.pos AS lag, [{_MEANS}] AS means
  FROM fx_profile a JOIN fx_profile b
    ON a.accession = b.accession AND b.pos > a.pos AND b.pos <= a.pos + {MAX_LAG}
  GROUP BY a.accession, b.pos - a.pos),
widths AS (
  SELECT accession, positions, least(20, 140 // greatest(1, least({MAX_LAG}, positions - 1))) AS width
  FROM profile_stats),
profile_lags AS (
  SELECT accession, positions,
         list_resize(flatten(coalesce(list(means[1:width] ORDER BY lag) FILTER (means IS NOT NULL),
                                      []::DOUBLE[][])), 140, 0.0::DOUBLE) AS profile_lags
  FROM widths LEFT JOIN lag_means USING (accession) GROUP BY accession, positions),
profile_features AS (
  SELECT accession, list_concat(profile_stats, profile_lags) AS profile_vector
  FROM profile_stats JOIN profile_lags USING (accession))"""

# --- fixed values: the atoms of a compound string, as SQL reads them ------------------------------
BRACKET_ATOM = r"\[[0-9]*([A-Z][a-z]?|[a-z]+|\*)[^\]]*\]"
ORGANIC_LETTERS = "BCNOPSFIbcnops"
ELEMENT_COUNTS = {
    "CarbonCount": "C", "NitrogenCount": "N", "OxygenCount": "O", "SulfurCount": "S", "PhosphorusCount": "P",
    "FluorineCount": "F", "ChlorineCount": "Cl", "BromineCount": "Br", "IodineCount": "I",
}
HALOGENS = ["F", "Cl", "Br", "I"]
SAME_AS = {"LipinskiViolations": "RotBonds", "MolLogP": "LogP", "MolMR": "MR"}
# --------------------------------------------------------------------------------------------------

# The SQL lists the atoms one by one; the engine counts letters.
_TOKEN = f"{BRACKET_ATOM.replace('(', '(?:')}|Br|Cl|[{ORGANIC_LETTERS}]|\\*"


def _census_sql(source, key, text):
    def count(*symbols):
        wanted = ", ".join(f"'{s}'" for s in symbols)
        return f"len(list_filter(symbols, lambda s: s IN ({wanted})))"

    counts = {name: count(symbol) for name, symbol in ELEMENT_COUNTS.items()}
    counts["HalogenCount"] = count(*HALOGENS)
    counts["HeavyAtomCount"] = "len(list_filter(symbols, lambda s: s <> '*'))"
    counts["AtomCount"] = "len(symbols)"
    counts["NO_Count"] = count("N", "O")
    columns = ", ".join(f"{c}::BIGINT AS {n}" for n, c in counts.items())
    return f"""tokens AS (
  SELECT {key}, list_transform(regexp_extract_all({text}, '{_TOKEN}'), lambda t:
    CASE WHEN t[1] = '[' THEN regexp_extract(t, '{BRACKET_ATOM}', 1) ELSE t END) AS raw
  FROM {source}),
symbol_lists AS (
  SELECT {key}, list_filter(list_transform(raw, lambda t: concat(upper(t[1]), lower(t[2:]))),
                            lambda s: s <> 'H') AS symbols
  FROM tokens),
census AS (SELECT {key}, {columns} FROM symbol_lists)"""


_FLAGS = {
    "RO5_Violations": "(HBD > 5 OR HBA > 10 OR (MW > 500 AND NOT isnan(MW)) OR (LogP > 5 AND NOT isnan(LogP)))",
    "GhoseViolations": "NOT (MW BETWEEN 160 AND 480 AND LogP BETWEEN -0.4 AND 5.6 "
    "AND d.AtomCount BETWEEN 20 AND 70 AND RotBonds BETWEEN 0 AND 10)",
    "VeberViolations": "(RotBonds > 10 OR (TPSA > 140 AND NOT isnan(TPSA)))",
}
_TABLE = ["MW", "LogP", "HBA", "HBD", "RotBonds", "AtomCount", "TPSA", "MR"]


def _descriptor_values(census):
    """SQL per descriptor over ``fx_descriptors d`` and, if given, ``census c``."""
    values = {}
    for name in DESCRIPTORS:
        source = SAME_AS.get(name, name)
        if name in _FLAGS:
            text = f"CAST({_FLAGS[name]} AS INT)"
        elif source in _TABLE:
            text = f"d.{source}"
        elif census and (name in ELEMENT_COUNTS or name in ("HalogenCount", "HeavyAtomCount", "NO_Count")):
            text = f"c.{name}"
        else:
            text = "0.0"
        number = f"CAST({text} AS DOUBLE)"
        values[name] = f"coalesce(CASE WHEN isfinite({number}) THEN {number} END, 0.0::DOUBLE)"
    return values


COMPOUND = f"""{inputs.DESCRIPTORS},
{_census_sql('compounds', 'compound_cid', 'smile')},
compound_features AS (
  SELECT compound_cid, [{', '.join(_descriptor_values(True).values())}] AS compound_vector
  FROM census c LEFT JOIN fx_descriptors d USING (compound_cid))"""

ASSEMBLED = f"""{ENTITIES}, {SEQUENCE}, {PROFILE}, {COMPOUND},
assembled AS (
  SELECT r.*, s.sequence_length, profile_vector IS NOT NULL AS pssm_available, sequence_vector,
         coalesce(profile_vector, list_resize([]::DOUBLE[], 220, 0.0::DOUBLE)) AS profile_vector,
         compound_vector, p.first_row = row_no AS protein_is_unique,
         q.first_row = row_no AS compound_is_unique
  FROM fx_interactions r
  JOIN proteins p USING (accession) JOIN compounds q USING (compound_cid)
  JOIN sequence_features s USING (accession)
  LEFT JOIN profile_features USING (accession) JOIN compound_features USING (compound_cid))"""


# One division, a maximum or a given value: the same bits in both engines. Rounding these could
# differ where a value lies halfway between two decimals.
EXACT = frozenset(
    n
    for n in sequence_names() + profile_names() + compound_names()
    if n.startswith(("Length", "AA_", "PSSM_Max_", "PSSM_Min_", "Compound_"))
)


def _vector_sql(vector, names):
    return ", ".join(
        f"{vector}[{i}] AS {n}" if n in EXACT else f"round({vector}[{i}], 6) AS {n}"
        for i, n in enumerate(names, start=1)
    )


def _features_sql(by_lag=False):
    return {
        "protein": f"{_vector_sql('sequence_vector', sequence_names())}, "
        f"{_vector_sql('profile_vector', profile_names(by_lag))}",
        "compound": _vector_sql("compound_vector", compound_names()),
    }


def assembled(spark, d, flagged=False):
    return feature_table(
        inputs.interactions(spark, d),
        inputs.profile_rows(spark, d),
        inputs.descriptors(spark, d),
        on="compound_cid",
        flagged=flagged,
    )


# ---- scan and entities -------------------------------------------------------------------------


@register(
    "alias_projection",
    f"""WITH {inputs.INTERACTIONS}
SELECT accession, sequence, compound_cid, smile, '' AS label FROM fx_interactions""",
)
def _alias_projection(spark, d):
    frame = inputs.interactions(spark, d).select(
        F.col("accession").alias("ProteinID"),
        F.col("sequence").alias("Seq"),
        F.lit("not this one").alias("CompoundID"),
        F.col("compound_cid").alias("CID"),
        F.col("smile").alias("CanonicalSMILES"),
    )
    return interactions.select_fields(frame)


@register(
    "clean_fields",
    f"WITH {inputs.INTERACTIONS} SELECT * FROM fx_interactions",
)
def _clean_fields(spark, d):
    return interactions.clean_fields(inputs.raw_interactions(spark, d))


@register(
    "row_ordinal",
    "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, o_orderkey FROM orders",
)
def _row_ordinal(spark, d):
    tagged = ordinal.with_file_position(inputs.table(spark, d, "orders"))
    return ordinal.with_row_numbers(tagged.select(ordinal.FILE_POSITION, "o_orderkey"))


@register(
    "first_occurrence",
    f"""{ENTITIES} SELECT 'protein' AS entity, accession AS id, sequence AS value, first_row FROM proteins
UNION ALL SELECT 'compound', compound_cid, smile, first_row FROM compounds""",
)
def _first_occurrence(spark, d):
    rows = inputs.interactions(spark, d)
    parts = [
        ("protein", entities.unique_proteins(rows), "accession", "sequence"),
        ("compound", entities.unique_compounds(rows), "compound_cid", "smile"),
    ]
    frames = [
        frame.select(
            F.lit(kind).alias("entity"), F.col(key).alias("id"), F.col(value).alias("value"), "first_row"
        )
        for kind, frame, key, value in parts
    ]
    return frames[0].unionByName(frames[1])


@register(
    "first_rows_filtered",
    """SELECT customer, value, first_row FROM (
  SELECT o_custkey AS customer, o_orderstatus AS value, o_orderkey AS first_row,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
WHERE place = 1""",
)
def _first_rows_filtered(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("value")
    )
    return entities.filtered_first_occurrence(rows, "customer", "value", (0, entities.FILTERED[1]))


@register(
    "uniqueness_flags",
    f"""{ENTITIES} SELECT row_no, r.accession, r.compound_cid, p.first_row = row_no AS protein_is_unique,
  q.first_row = row_no AS compound_is_unique
FROM fx_interactions r JOIN proteins p USING (accession) JOIN compounds q USING (compound_cid)""",
)
def _uniqueness_flags(spark, d):
    rows = inputs.interactions(spark, d).select("row_no", "accession", "compound_cid")
    return entities.with_uniqueness_flags(rows)


@register(
    "pending_entities",
    f"{ENTITIES}, {inputs.STORE} SELECT accession, sequence, first_row FROM proteins "
    "WHERE accession NOT IN (SELECT accession FROM fx_store)",
)
def _pending_entities(spark, d):
    unique = entities.unique_proteins(inputs.interactions(spark, d))
    return entities.pending(unique, inputs.store_keys(spark, d), "accession")


def _stored_lengths(spark, d):
    """A store that holds the length of every finished protein, with a mark of its origin."""
    unique = entities.unique_proteins(inputs.interactions(spark, d))
    done = unique.join(inputs.store_keys(spark, d), "accession", "left_semi")
    return done.select(
        "accession", F.length("sequence").cast("long").alias("sequence_length"), F.lit("store").alias("origin")
    )


@register(
    "cached_features",
    f"""{ENTITIES}, {inputs.STORE}
SELECT accession, length(sequence) AS sequence_length,
       CASE WHEN accession IN (SELECT accession FROM fx_store) THEN 'store' ELSE 'computed' END AS origin
FROM proteins""",
)
def _cached_features(spark, d):
    unique = entities.unique_proteins(inputs.interactions(spark, d))

    def compute(todo):
        length = F.length("sequence").cast("long").alias("sequence_length")
        return todo.select("accession", length, F.lit("computed").alias("origin"))

    return entities.with_cached(unique, _stored_lengths(spark, d), "accession", compute)


@register(
    "store_resume",
    f"""{ENTITIES}, {inputs.STORE}
SELECT accession, length(sequence) AS sequence_length,
       CASE WHEN accession IN (SELECT accession FROM fx_store) THEN 'first' ELSE 'second' END AS origin
FROM proteins""",
)
def _store_resume(spark, d):
    """A store filled by one run with the finished proteins, in batches, and by a second one with the others."""
    unique = entities.unique_proteins(inputs.interactions(spark, d))
    done = unique.join(inputs.store_keys(spark, d), "accession", "left_semi")
    path = staging_path(spark, "store")

    def computed_by(run):
        length = F.length("sequence").cast("long").alias("sequence_length")
        return lambda todo: todo.select("accession", length, F.lit(run).alias("origin"))

    half = max(1, -(-done.count() // 2))
    extend_store(done, path, "accession", computed_by("first"), commit=half)
    return extend_store(unique, path, "accession", computed_by("second"))


@register(
    "progress_percent",
    f"""{ENTITIES}, {inputs.STORE}, n AS (
  SELECT count(*) AS total, count(*) FILTER (accession IN (SELECT accession FROM fx_store)) AS done
  FROM proteins)
SELECT done, total, round(done * 100.0::DOUBLE / greatest(total, 1), 6) AS percent FROM n""",
)
def _progress_percent(spark, d):
    unique = entities.unique_proteins(inputs.interactions(spark, d))
    return tidy(entities.progress(unique, inputs.store_keys(spark, d), "accession"))


# ---- sequences ---------------------------------------------------------------------------------


def _sequence_features(spark, d):
    return sequences.sequence_features(entities.unique_proteins(inputs.interactions(spark, d)))


@register(
    "aa_composition",
    f"{ENTITIES}, {SEQUENCE} SELECT accession, sequence_length, "
    + ", ".join(f"sequence_vector[{i}] AS AA_{aa}" for i, aa in enumerate(RESIDUES, start=2))
    + " FROM sequence_features",
)
def _aa_composition(spark, d):
    return tidy(sequences.composition(entities.unique_proteins(inputs.interactions(spark, d))), EXACT)


@register(
    "sequence_lag",
    f"{ENTITIES}, {SEQUENCE} SELECT accession, lag, "
    + ", ".join(
        f"round(sequence_vector[{21 + MAX_LAG * k} + lag], 6) AS {n.lower()}"
        for k, n in enumerate(PROPERTY_NAMES)
    )
    + f" FROM sequence_features CROSS JOIN range(1, {MAX_LAG + 1}) AS l(lag)",
)
def _sequence_lag(spark, d):
    return tidy(sequences.lag_values(_sequence_features(spark, d)))


@register(
    "residue_zscores",
    f"""{ENTITIES}, {_Z}
SELECT residue, round(p0, 6) AS hydrophobicity,
       round(p1, 6) AS isoelectric_point, round(p2, 6) AS molecular_weight,
       (SELECT sum(length(sequence) - length(replace(sequence, residue, '')))::BIGINT FROM proteins)
         AS occurrences
FROM residues""",
)
def _residue_zscores(spark, d):
    return tidy(sequences.residue_usage(entities.unique_proteins(inputs.interactions(spark, d))))


# ---- profiles ----------------------------------------------------------------------------------


def _wide(frame, key, vector, n, prefix, first=0):
    return frame.select(*key, *[F.col(vector)[first + i].alias(f"{prefix}{i + 1}") for i in range(n)])


def _wide_sql(vector, n, prefix, first=0):
    return ", ".join(f"round({vector}[{first + i}], 6) AS {prefix}{i}" for i in range(1, n + 1))


@register(
    "profile_parse",
    f"WITH {inputs.PROFILE_ROWS} SELECT accession, pos::BIGINT AS pos, "
    + ", ".join(f"round(scores[{i}] * 100)::DOUBLE AS s{i}" for i in _COLS)
    + " FROM fx_profile",
)
def _profile_parse(spark, d):
    rows = inputs.profile_rows(spark, d)
    scores = F.transform("r.scores", lambda x: F.round(x * 100).cast("int").cast("string"))
    line = F.concat_ws("  ", F.col("r.pos").cast("string"), F.lit("A"), F.array_join(scores, "  "), F.lit("0.5"))
    head = "\nLast position-specific scoring matrix computed\n           A  R  N  D\n"
    tail = "\n\n                      K         Lambda\n7  A 1 2 3\nStandard Ungapped    0.1 0.3\n"
    # a profile text is one small file: 12 positions at most here
    texts = (
        rows.select("accession", F.struct("pos", "scores").alias("r"))
        .select("accession", F.struct("r.pos", line.alias("line")).alias("entry"))
        .groupBy("accession")
        .agg(F.array_join(F.sort_array(F.collect_list("entry"))["line"], "\n").alias("body"))
    )
    files = texts.select("accession", F.concat(F.lit(head), "body", F.lit(tail)).alias("text"))
    parsed = parse_profiles(files, "accession", "text")
    return tidy(_wide(parsed, ["accession", "pos"], "scores", 20, "s"))


@register(
    "profile_stats",
    f"WITH {PROFILE} SELECT accession, positions, {_wide_sql('profile_stats', 80, 'v')} FROM profile_stats",
)
def _profile_stats(spark, d):
    stats = profiles.profile_stats(inputs.profile_rows(spark, d))
    return tidy(_wide(stats, ["accession", "positions"], "profile_stats", 80, "v"))


@register(
    "profile_lag",
    f"WITH {PROFILE} SELECT accession, positions, {_wide_sql('profile_lags', 140, 'v')} FROM profile_lags",
)
def _profile_lag(spark, d):
    lags = profiles.profile_lags(inputs.profile_rows(spark, d))
    return tidy(_wide(lags, ["accession", "positions"], "profile_lags", 140, "v"))


@register(
    "profile_lookup",
    f"""{ENTITIES}, {inputs.PROFILE_ROWS}
SELECT concat('db|', accession, '/1') AS accession,
       accession IN (SELECT accession FROM fx_profile) AS pssm_available
FROM proteins""",
)
def _profile_lookup(spark, d):
    unique = entities.unique_proteins(inputs.interactions(spark, d))
    named = unique.select(F.concat(F.lit("db|"), "accession", F.lit("/1")).alias("accession"))
    stems = inputs.profile_rows(spark, d).select(
        F.concat(F.lit("db_"), "accession", F.lit("_1")).alias("stem")
    )
    return with_profile_flag(named, stems)


# ---- compounds ---------------------------------------------------------------------------------


@register(
    "druglike_flags",
    f"WITH {inputs.DESCRIPTORS} SELECT compound_cid, "
    + ", ".join(f"CAST({c} AS INT)::BIGINT AS {n}" for n, c in _FLAGS.items())
    + " FROM fx_descriptors d",
)
def _druglike_flags(spark, d):
    flags = compounds.rule_flags()
    return tidy(
        inputs.descriptors(spark, d).select("compound_cid", *[c.alias(n) for n, c in flags.items()])
    )


@register(
    "descriptor_align",
    f"WITH {inputs.DESCRIPTORS} SELECT compound_cid, "
    + ", ".join(f"round({v}, 6) AS {n}" for n, v in _descriptor_values(False).items())
    + " FROM fx_descriptors d",
)
def _descriptor_align(spark, d):
    table = compounds.complete_descriptors(inputs.descriptors(spark, d))
    return tidy(table.select("compound_cid", *compounds.aligned(table)))


@register(
    "element_census", f"WITH {_census_sql('documents', 'doc_id', 'text')} SELECT * FROM census"
)
def _element_census(spark, d):
    return compounds.element_census(inputs.documents(spark, d, "doc_id", "text"), "doc_id", "text")


# ---- assembly and outputs ----------------------------------------------------------------------


@register(
    "attach_protein",
    f"""{ENTITIES}, {SEQUENCE}, {PROFILE}, {inputs.STORE}
SELECT row_no, accession, length(r.sequence) AS own_length,
       coalesce(s.sequence_length, length(r.sequence)) AS sequence_length,
       coalesce(s.accession IS NOT NULL AND profile_vector IS NOT NULL, false) AS pssm_available,
       coalesce(round(sequence_vector[1], 6), length(r.sequence)) AS first_value,
       coalesce(round(sequence_vector[22], 6), 0.0::DOUBLE) AS first_lag,
       CASE WHEN s.accession IS NULL THEN 0.0::DOUBLE
            ELSE coalesce(round(profile_vector[1], 6), 0.0::DOUBLE) END AS first_mean
FROM fx_interactions r
LEFT JOIN (SELECT * FROM sequence_features SEMI JOIN fx_store USING (accession)) s USING (accession)
LEFT JOIN profile_features USING (accession)""",
)
def _attach_protein(spark, d):
    rows = inputs.interactions(spark, d)
    done = entities.unique_proteins(rows).join(inputs.store_keys(spark, d), "accession", "left_semi")
    features = assemble.protein_features(
        sequences.sequence_features(done), profiles.profile_features(inputs.profile_rows(spark, d))
    )
    out = assemble.attach_proteins(assemble.with_own_length(rows), features)
    return tidy(
        out.select(
            "row_no",
            "accession",
            "own_length",
            "sequence_length",
            "pssm_available",
            F.col("sequence_vector")[0].alias("first_value"),
            F.col("sequence_vector")[21].alias("first_lag"),
            F.col("profile_vector")[0].alias("first_mean"),
        )
    )


@register(
    "attach_compound",
    f"""WITH {inputs.INTERACTIONS}, {inputs.DESCRIPTORS},
d AS (SELECT * REPLACE (concat('C', substr(compound_cid, 2)::BIGINT * 2) AS compound_cid)
      FROM fx_descriptors)
SELECT row_no, compound_cid, {', '.join(f'round({v}, 6) AS {n}' for n, v in _descriptor_values(False).items())}
FROM fx_interactions LEFT JOIN d USING (compound_cid)""",
)
def _attach_compound(spark, d):
    """Only every other compound has descriptors; the others get zeros."""
    table = compounds.complete_descriptors(inputs.descriptors(spark, d))
    number = F.substring("compound_cid", 2, 20).cast("long") * 2
    features = table.select(
        F.concat(F.lit("C"), number).alias("compound_cid"),
        F.array(*compounds.aligned(table)).alias("compound_vector"),
    )
    out = assemble.attach_compounds(inputs.interactions(spark, d), features)
    return tidy(out.select("row_no", "compound_cid", *assemble.expand("compound_vector", DESCRIPTORS)))


@register(
    "combined_matrix",
    f"{ASSEMBLED} SELECT accession AS Protein_Accession, {_features_sql()['protein']}, "
    f"compound_cid AS Compound_CID, {_features_sql()['compound']}, label AS Label FROM assembled",
)
def _combined_matrix(spark, d):
    last = inputs.interactions(spark, d).agg(F.max("row_no")).first()[0]
    ordered = files.in_row_order(assembled(spark, d), last=last)
    return tidy(ordered.select(assemble.combined_columns()), EXACT)


@register(
    "detailed_matrix",
    f"""{ASSEMBLED} SELECT row_no AS Original_Row_Number, accession AS Protein_Accession,
  compound_cid AS Compound_CID, smile AS Smile, sequence_length AS Sequence_Length,
  pssm_available AS PSSM_Available, {_features_sql()['protein']}, {_features_sql()['compound']},
  label AS Label FROM assembled""",
)
def _detailed_matrix(spark, d):
    return tidy(assembled(spark, d).select(assemble.detailed_columns()), EXACT)


@register(
    "detailed_matrix_flags",
    f"""{ASSEMBLED} SELECT accession AS Protein_Accession, compound_cid AS Compound_CID, smile AS Smile,
  sequence_length AS Sequence_Length, pssm_available AS PSSM_Available, row_no AS Row_Number,
  protein_is_unique AS Protein_Is_Unique, compound_is_unique AS Compound_Is_Unique,
  {_features_sql(True)['protein']}, {_features_sql(True)['compound']}, label AS Label FROM assembled""",
)
def _detailed_matrix_flags(spark, d):
    return tidy(assembled(spark, d, flagged=True).select(assemble.flagged_columns()), EXACT)


@register(
    "order_verification",
    f"""WITH {inputs.INTERACTIONS},
placed AS (SELECT row_number() OVER (ORDER BY row_no) AS position, * FROM fx_interactions)
SELECT position AS Position, row_no AS Original_Row_Number, accession AS Protein_Accession,
       compound_cid AS Compound_CID,
       CASE WHEN position = row_no THEN 'YES' ELSE 'NO' END AS Order_OK FROM placed""",
)
def _order_verification(spark, d):
    return tables.order_verification(inputs.interactions(spark, d))


@register(
    "processing_stats",
    f"""WITH {inputs.INTERACTIONS}, {inputs.PROFILE_ROWS},
flagged AS (SELECT *, accession IN (SELECT accession FROM fx_profile) AS has FROM fx_interactions),
n AS (SELECT count(*) AS total_records, count(DISTINCT accession) AS unique_proteins,
             count(DISTINCT compound_cid) AS unique_compounds,
             count(*) FILTER (has) AS rows_with_profile,
             count(DISTINCT accession) FILTER (has) AS proteins_with_profile FROM flagged)
SELECT *, round((total_records - unique_proteins) * 100.0::DOUBLE / total_records, 6) AS protein_dedup_rate,
       round((total_records - unique_compounds) * 100.0::DOUBLE / total_records, 6) AS compound_dedup_rate,
       51::BIGINT AS protein_pseaac, 220::BIGINT AS protein_psepssm, 64::BIGINT AS compound,
       335::BIGINT AS total FROM n""",
)
def _processing_stats(spark, d):
    rows = inputs.interactions(spark, d).select("accession", "compound_cid")
    stems = inputs.profile_rows(spark, d).select(F.col("accession").alias("stem"))
    found = tables.processing_stats(with_profile_flag(rows, stems))
    return tidy(found.select("*", "feature_dimensions.*").drop("feature_dimensions"))


_GROUP = {n: group for group, members in DESCRIPTOR_GROUPS.items() for n in members}
_NAMES = ", ".join(
    f"('{block}', {i}, '{name}', {repr(group) if group else 'NULL'}, {at})"
    for at, (block, i, name, group) in enumerate(
        [
            *[("sequence", i, n, None) for i, n in enumerate(sequence_names())],
            *[("profile", i, n, None) for i, n in enumerate(profile_names())],
            *[("compound", i, f"Compound_{n}", _GROUP.get(n)) for i, n in enumerate(DESCRIPTORS)],
        ],
        start=1,
    )
)


@register(
    "feature_dictionary",
    f"""{ASSEMBLED}, names(block, idx, name, descriptor_group, place) AS (VALUES {_NAMES}),
flat AS (SELECT list_concat(sequence_vector, profile_vector, compound_vector) AS v FROM assembled),
used AS (SELECT place, count(*) AS nonzero FROM
           (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS place FROM flat) WHERE x <> 0 GROUP BY place)
SELECT block, idx::BIGINT AS idx, name, descriptor_group, coalesce(nonzero, 0) AS nonzero
FROM names LEFT JOIN used USING (place)""",
)
def _feature_dictionary(spark, d):
    """The dictionary as it is written and read back, with the rows in which each feature is not zero."""
    path = staging_path(spark, "dictionary")
    files.write_json(tables.feature_names(spark), path)
    schema = "block string, idx long, name string, descriptor_group string"
    written = spark.read.schema(schema).json(path)
    used = assemble.feature_usage(assembled(spark, d))
    return tidy(written.join(used, ["block", "idx"], "left").fillna(0, ["nonzero"]))


@register(
    "interaction_files",
    """WITH cells AS (
  SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN '' ELSE concat('P', doc_id // 3) END AS accession,
         regexp_replace(text, '[^A-Za-z]', '', 'g') AS sequence, concat('C', doc_id // 2) AS compound_cid,
         lang AS smile, source AS label FROM documents)
SELECT row_number() OVER (ORDER BY doc_id) AS row_no, accession, upper(sequence) AS sequence, compound_cid, smile, label
FROM cells""",
)
def _interaction_files(spark, d):
    """The documents written as a CSV of interactions, in order, and read back by its header."""
    rows = inputs.documents(spark, d, "doc_id", "text", "lang", "source")
    accession = F.when(F.col("doc_id") % 97 == 5, "").otherwise(F.concat(F.lit("P"), F.expr("doc_id div 3")))
    written = rows.select(
        (F.col("doc_id") + 1).alias("row_no"),
        F.col("source").alias("Label"),
        accession.alias("ProteinID"),
        F.regexp_replace("text", "[^A-Za-z]", "").alias("Seq"),
        F.lit("a,b\"c").alias("Note"),
        F.concat(F.lit("C"), F.expr("doc_id div 2")).alias("CID"),
        F.col("lang").alias("SMILES"),
    )
    path = staging_path(spark, "interactions")
    files.write_csv(files.in_row_order(written).drop("row_no"), path)
    return interactions.read_interactions(spark, path)


@register(
    "quoted_interactions",
    f"""SELECT row_number() OVER (ORDER BY doc_id) AS row_no,
       CASE WHEN doc_id % 97 = 5 THEN '' ELSE concat('P', doc_id // 3) END AS accession,
       upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence, concat('C', doc_id // 2) AS compound_cid,
       trim(replace(text, '. ', '."' || chr(10) || ',"'), {inputs.SPACES}) AS smile, source AS label
FROM documents""",
)
def _quoted_interactions(spark, d):
    """The documents as a CSV whose cells are full of quotes and line breaks, written in order and read back in splits."""
    rows = inputs.documents(spark, d, "doc_id", "text", "source")
    accession = F.when(F.col("doc_id") % 97 == 5, "").otherwise(F.concat(F.lit("P"), F.expr("doc_id div 3")))
    written = rows.select(
        (F.col("doc_id") + 1).alias("row_no"),
        F.replace("text", F.lit(". "), F.lit('."\n,"')).alias("Smile"),
        accession.alias("ProteinID"),
        F.regexp_replace("text", "[^A-Za-z]", "").alias("Seq"),
        F.concat(F.lit("C"), F.expr("doc_id div 2")).alias("CID"),
        F.col("source").alias("Label"),
    )
    path = staging_path(spark, "quoted")
    files.write_csv(files.in_row_order(written).drop("row_no"), path)
    return interactions.read_interactions(spark, path, multi_line=True)
