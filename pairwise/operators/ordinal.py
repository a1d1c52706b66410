"""Dense 1-based row numbers without a global sort."""

from pyspark.sql import DataFrame, Window, functions as F

from pairwise.session import stage

FILE_POSITION = "_file_position"


def with_file_position(df: DataFrame) -> DataFrame:
    """Tag each scanned row with its file, its split and its order inside the split.

    Must sit directly on a file scan.
    """
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    return df.select("*", position.alias(FILE_POSITION))


def with_row_numbers(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Replace the file position by the row's ordinal in (file, split, line) order.

    One pass counts the rows of every split; a running sum over that table (one row per split, so
    bytes scanned / 128 MB at most) gives each split its offset. The offsets are staged: their
    written size decides whether the join back is a broadcast.
    """
    file, block, row = (F.col(f"{FILE_POSITION}.{part}") for part in ("file", "block", "id"))
    blocks = df.groupBy(file.alias("_file"), block.alias("_block")).agg(
        F.count("*").alias("_rows"), F.min(row).alias("_first")
    )
    inside = Window.partitionBy("_file").orderBy("_block")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        blocks.groupBy("_file")
        .agg(F.sum("_rows").alias("_file_rows"))
        .withColumn("_file_start", F.coalesce(F.sum("_file_rows").over(before), F.lit(0)))
        .drop("_file_rows")
    )
    starts = blocks.join(files, "_file").select(
        "_file",
        "_block",
        (
            F.col("_file_start")
            + F.coalesce(
                F.sum("_rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            )
            - F.col("_first")
            + 1
        ).alias("_shift"),
    )
    starts = stage(starts, "row-offsets")
    joined = df.join(starts, (file == F.col("_file")) & (block == F.col("_block")))
    columns = [c for c in df.columns if c != FILE_POSITION]
    return joined.select((row + F.col("_shift")).alias(name), *columns)


def with_positions(df: DataFrame, order_by: str, name: str, chunk: int = 100_000) -> DataFrame:
    """1-based position of every row in the order of a distinct integer column.

    The column is cut into ranges of ``chunk`` values; rows are ranked inside their range and a
    running sum over the range counts places the ranges. Gaps in the column do not matter.
    """
    part = F.floor(F.col(order_by) / chunk)
    tagged = df.withColumn("_range", part)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order_by))
    return (
        tagged.withColumn("_rank", rank)
        .join(starts, "_range")
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_range", "_rank", "_start")
    )
