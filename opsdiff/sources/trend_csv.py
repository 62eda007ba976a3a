"""Trends from wide CSV text: one time column, one column per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.functions.text import strip

# A cell, quoted or not, after the start of the line or a comma.
_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def csv_cells(line: Column) -> Column:
    """The cells of one line of CSV, without their quotes."""
    return F.transform(
        F.regexp_extract_all(line, F.lit(_CELL), F.lit(1)),
        lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c),
    )


def read_trend_csv(spark: SparkSession, path: str, host: str | None = None, host_pattern: str | None = None) -> DataFrame:
    """(host, series, bucket, value): one row per cell.

    Every file has its own header; the files of a whole fleet are read in one pass.  The
    host is the same for all, or the first group of ``host_pattern`` in a file's path.
    Rows with a malformed time are skipped; an empty cell, N/A, ? or anything else that is
    no number is a NULL point.  A short row has no points for the columns it lacks.
    ValueError when no file has a series.
    """
    if (host is None) == (host_pattern is None):
        raise ValueError("give the host or a pattern that finds it in the path")
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"),
    ).where("line != ''")
    # Lines of a block keep their order, so the header is the first line of a file's first block.
    headers = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("n", "line")).alias("first")).select(
        "file", F.col("first.n").alias("header_n"), csv_cells(F.col("first.line")).alias("names")
    )
    if not headers.where("size(names) > 1").limit(1).count():
        raise ValueError("the file has no series; the window may have no data")
    rows = lines.join(headers, "file").where(F.col("n") != F.col("header_n")).select("file", "names", csv_cells(F.col("line")).alias("cells"))
    time = strip(F.element_at("cells", 1))
    pairs = F.arrays_zip(F.slice("names", 2, 1 << 20).alias("series"), F.slice("cells", 2, 1 << 20).alias("cell"))
    # Of a long row the cells beyond the header have no series, of a short one the series no cells.
    common = F.slice(pairs, F.lit(1), F.least(F.size("names"), F.size("cells")) - 1)
    cell = strip(F.col("cell"))
    # A cast would take 1.5f and 1.5d for numbers as Java does.
    number = F.when(~cell.rlike(r"[0-9.][fFdD]$"), cell.try_cast("double"))
    of_file = F.lit(host) if host is not None else F.regexp_extract("file", host_pattern, 1)
    return (
        rows.select(
            of_file.alias("host"),
            F.when(
                time.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}(\.\d+)?$"),
                time.try_cast("timestamp_ntz"),
            ).alias("bucket"),
            F.inline(common),
        )
        .where(F.col("bucket").isNotNull())
        .select("host", strip(F.col("series")).alias("series"), "bucket", F.when(~F.isnan(number), number).alias("value"))
    )
