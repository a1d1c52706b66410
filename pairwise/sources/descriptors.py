"""Compound descriptor tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairwise.constants import DESCRIPTORS
from pairwise.functions.scalar import number, strip
from pairwise.sources.interactions import scan_csv
from pairwise.sources.listing import by_header, escaped, table_files


def read_descriptors(spark: SparkSession, path) -> DataFrame:
    """``smile`` plus every known descriptor of the files, as doubles, whatever the column order.

    A byte order mark and CRLF line ends are accepted. Files may have unlike headers; a descriptor
    that a file lacks is missing in its rows.
    """
    parts = []
    for header, files in by_header(spark, table_files(spark, path)).items():
        known = [name for name in DESCRIPTORS if name in header]
        places = {name: header.index(name) for name in ["SMILES", *known]}
        table = scan_csv(spark, [escaped(p) for p in files], len(header), places)
        cells = [number(F.col(n)).alias(n) for n in known]
        parts.append(table.select(strip(F.col("SMILES")).alias("smile"), *cells))
    if not parts:
        raise FileNotFoundError(f"no descriptor file with a header in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
