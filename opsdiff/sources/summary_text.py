"""Window means from summary text, one metric per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.functions.text import strip

# Fixed pattern of a line: metric, optional ["instance"], number, units.
SUMMARY_LINE = r'^(\S+)(?:\s+\["(.*?)"\])?\s+(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*(.*)$'
BANNER = "Performance metrics"


def parse_summary(lines: DataFrame, line: str = "value") -> DataFrame:
    """metric, instance, val and units of every line that has them; other columns are kept.

    Blank lines, lines that start with a blank, the banner and lines that do
    not match are dropped.  Without an instance the instance is ''.
    """
    text = strip(F.col(line))

    def part(i: int) -> Column:
        return F.regexp_extract(text, SUMMARY_LINE, i)

    keep = [c for c in lines.columns if c != line]
    return (
        lines.where(
            ~F.col(line).startswith(" ") & ~text.startswith(BANNER) & text.rlike(SUMMARY_LINE)
        )
        .select(
            *keep, part(1).alias("metric"), part(2).alias("instance"),
            part(3).try_cast("double").alias("val"), strip(part(4)).alias("units"),
        )
        .where(F.col("val").isNotNull() & (F.abs("val") < float("inf")))
    )


def read_summary_text(spark: SparkSession, path: str, host: str | None = None, host_pattern: str | None = None) -> DataFrame:
    """(host, metric, instance, val, units, seq) of the summary files of one host or a fleet.

    The host is the same for all files, or the first group of ``host_pattern`` in a file's
    path.  ``seq`` sorts by file and place in it, so that of a repeated series the last line of
    the last file counts.
    """
    if (host is None) == (host_pattern is None):
        raise ValueError("give the host or a pattern that finds it in the path")
    file = F.col("_metadata.file_path")
    seq = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path, lineSep="\n").select(
        (F.lit(host) if host is not None else F.regexp_extract(file, host_pattern, 1)).alias("host"), seq.alias("seq"), "value"
    )
    return parse_summary(lines)
