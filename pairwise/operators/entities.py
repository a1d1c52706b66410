"""Distinct proteins and compounds, and which of them still need features."""

from pyspark.sql import Column, DataFrame, functions as F

from pairwise.functions.scalar import percent
from pairwise.session import stage

# A filter of first rows is broadcast between these numbers of entities: fewer are broadcast by themselves,
# and more would make it larger than 2 bytes x 20 million.
FILTERED = (500_000, 20_000_000)
BLOCK_WORDS = 64  # of 64 bits, in one row of the filter
BLOCK_KEYS = 256  # so 16 bits for each key
PROBES = 4  # 12 bits of a hash each


def _probes(row: Column) -> list[Column]:
    """Bits of a block at which a row number is marked."""
    hashed = F.xxhash64(row, F.lit(1))
    return [F.shiftright(hashed, 12 * k).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1)).cast("int") for k in range(PROBES)]


def _block(row: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks))


def row_filter(firsts: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A Bloom filter of the ``n`` numbers in ``first_row``: ``block, words``, and the number of blocks."""
    blocks, row = max(1, -(-n // BLOCK_KEYS)), F.col("first_row")
    bits = firsts.select(_block(row, blocks).alias("block"), F.explode(F.array(*_probes(row))).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    words = bits.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"))
    marked = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("marked"))
    every = F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))
    filled = F.transform(every, lambda w: F.coalesce(F.try_element_at("marked", w), F.lit(0).cast("long")))
    return marked.select("block", filled.alias("words")), blocks


def may_be_first(rows: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """The rows that pass a broadcast filter of the first rows: all of these, and few others."""
    made, blocks = row_filter(firsts, n)
    row = F.col("row_no")
    held = rows.join(F.broadcast(made), _block(row, blocks) == F.col("block"))
    for bit in _probes(row):
        held = held.filter(F.getbit(F.get("words", F.floor(bit / 64).cast("int")), bit % 64) == 1)
    return held.select(*rows.columns)


def first_occurrence(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row per ``key`` with the ``value`` of its first row.

    A hash aggregate finds the first rows, without values and combined before the shuffle, so a key
    that holds a large share of the rows does no harm. Their values are then looked up by row number,
    which is unique. An aggregate that carried the values would sort them all first.
    """
    firsts = rows.groupBy(key).agg(F.min("row_no").alias("first_row")).select("first_row")
    return rows.join(firsts, rows["row_no"] == firsts["first_row"]).select(key, value, "first_row")


def filtered_first_occurrence(rows: DataFrame, key: str, value: str, filtered: tuple[int, int] = FILTERED) -> DataFrame:
    """``first_occurrence`` for a staged table: the first rows are written, so their number decides the lookup.

    A few hundred thousand are broadcast; for millions a Bloom filter of bounded size is, and only rows that
    pass it are shuffled; beyond that, and where most rows are first ones, all are.
    """
    counted = rows.groupBy(key).agg(F.min("row_no").alias("first_row"), F.count("*").alias("n"))
    firsts = stage(counted.select("first_row", "n"), "first-rows")
    n, total = firsts.agg(F.count("*"), F.sum("n")).first()
    firsts = firsts.select("first_row")
    if filtered[0] <= n <= filtered[1] and 2 * n <= (total or 0):
        rows = may_be_first(rows, firsts, n)
    return rows.join(firsts, rows["row_no"] == firsts["first_row"]).select(key, value, "first_row")


def unique_proteins(rows: DataFrame, staged: bool = False) -> DataFrame:
    return (filtered_first_occurrence if staged else first_occurrence)(rows, "accession", "sequence")


def unique_compounds(rows: DataFrame, staged: bool = False) -> DataFrame:
    return (filtered_first_occurrence if staged else first_occurrence)(rows, "compound_cid", "smile")


def with_uniqueness_flags(rows: DataFrame) -> DataFrame:
    """Mark the rows at which a protein or a compound appears for the first time.

    Joins on the row number, which is unique, so a frequent protein does not make a hot partition.
    """

    def first_rows(key: str, flag: str) -> DataFrame:
        firsts = rows.groupBy(key).agg(F.min("row_no").alias("row_no"))
        return firsts.select("row_no", F.lit(True).alias(flag))

    proteins = first_rows("accession", "protein_is_unique")
    compounds = first_rows("compound_cid", "compound_is_unique")
    flagged = rows.join(proteins, "row_no", "left").join(compounds, "row_no", "left")
    return flagged.withColumns(
        {
            "protein_is_unique": F.coalesce("protein_is_unique", F.lit(False)),
            "compound_is_unique": F.coalesce("compound_is_unique", F.lit(False)),
        }
    )


def pending(unique: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Entities that the feature store does not hold yet."""
    return unique.join(store.select(key), key, "left_anti")


def with_cached(unique: DataFrame, store: DataFrame, key: str, compute) -> DataFrame:
    """Stored features of the wanted entities plus computed features of the others.

    ``compute`` maps a frame of entities to a frame with the columns of ``store``.
    """
    reused = store.join(unique.select(key), key, "left_semi")
    return reused.unionByName(compute(pending(unique, store, key)).select(store.columns))


def run_totals(rows: DataFrame, profiled: Column | None = None) -> DataFrame:
    """Record and entity counts; ``profiled`` marks rows whose protein has a profile.

    Rows are counted by protein and by compound, each combined before its shuffle, and the two tables
    of entities are counted in turn. Several distinct counts at once would multiply the rows first.
    """
    has = F.lit(False) if profiled is None else profiled
    proteins = rows.groupBy("accession").agg(F.count("*").alias("n"), F.count_if(has).alias("with"))
    compounds = rows.groupBy("compound_cid").agg(F.count("*").alias("n"))
    none = F.lit(0)
    parts = [
        proteins.agg(
            F.sum("n").alias("total_records"),
            F.count("*").alias("unique_proteins"),
            none.alias("unique_compounds"),
            F.sum("with").alias("rows_with_profile"),
            F.count_if(F.col("with") > 0).alias("proteins_with_profile"),
        ),
        compounds.agg(
            none.alias("total_records"),
            none.alias("unique_proteins"),
            F.count("*").alias("unique_compounds"),
            none.alias("rows_with_profile"),
            none.alias("proteins_with_profile"),
        ),
    ]
    union = parts[0].unionByName(parts[1])
    names = union.columns if profiled is not None else union.columns[:3]
    totals = union.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    total = F.col("total_records")
    return totals.withColumns(
        {
            "protein_dedup_rate": percent(total - F.col("unique_proteins"), total),
            "compound_dedup_rate": percent(total - F.col("unique_compounds"), total),
        }
    )


def progress(unique: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Share of the distinct entities that the store already holds."""
    done = store.select(key, F.lit(1).alias("_done")).dropDuplicates([key])
    counts = unique.join(done, key, "left").agg(
        F.count("*").alias("total"), F.count("_done").alias("done")
    )
    percent_done = F.col("done") * 100.0 / F.greatest("total", F.lit(1))
    return counts.select("done", "total", percent_done.alias("percent"))
