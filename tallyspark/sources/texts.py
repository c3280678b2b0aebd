"""Transcripts, tables and file trees (SRC01-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The form of a transcript line and the manifest's columns.
LINE = r'^\(\s*(\S+)\s+"(.*)"\s*\)\s*$'
MANIFEST = "dataset string, utt_id string, path string, speaker_id string, duration_s double, sample_rate int, channels int, n_samples int, transcript string, has_transcript int, n_chars int"


def line_transcripts(lines: DataFrame) -> DataFrame:
    """utt_id and transcript of lines like ( id " text " ); other lines are skipped. lines: value."""
    return lines.where(F.col("value").rlike(LINE)).select(F.regexp_extract("value", LINE, 1).alias("utt_id"), F.regexp_replace(F.regexp_extract("value", LINE, 2), r"^\s+|\s+$", "").alias("transcript"))


def tab_transcripts(lines: DataFrame) -> DataFrame:
    """utt_id, speaker_id, transcript of lines with three fields or more; the rest of a line belongs to the text's field no more."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 3).select(f[0].alias("utt_id"), f[1].alias("speaker_id"), f[2].alias("transcript"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated manifest with header; quotes are ordinary characters."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(MANIFEST).csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with header."""
    rows.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, utt_id (file name without suffix) and length of the files under ``path``; their content isn't read. Spark lists no empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), f"\\Q{suffix}\\E$", "").alias("utt_id"), "length")
