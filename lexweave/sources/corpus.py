"""Text tables as lines, and the small configuration files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import ClassRange

TRIMMED = " \t\r"


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it is too small for as many splits of files. Larger inputs, and streams, aren't moved.

    The size is the plan's own estimate, so no job runs for it; a plan that holds a repartitioning already is left alone.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = plan.stats().sizeInBytes() < cores * split
    return df.repartition(cores) if small and "Repartition" not in plan.toString() else df


def corpus_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, line): the lines of every text without white space at their end; empty ones are left out."""
    split = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    return split.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.rtrim("raw", F.lit(TRIMMED)).alias("line")).filter("line <> ''")


def tokenizer_lines(docs: DataFrame, max_line_bytes: int = 16384) -> DataFrame:
    """As corpus_lines, but only a carriage return is cut off, and lines over so many bytes are left out."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = split.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.rtrim("raw", F.lit("\r")).alias("line"))
    return lines.filter((F.octet_length("line") <= max_line_bytes) & (F.col("line") != ""))


def within_limits(lines: DataFrame, max_line_bytes: int = 4096, max_sentence_cp: int | None = 2048) -> DataFrame:
    ok = F.octet_length("line") <= max_line_bytes
    return lines.filter(ok if max_sentence_cp is None else ok & (F.char_length("line") <= max_sentence_cp))


def with_eol(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.concat("line", F.lit("▃")))


def text_file(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(doc_id, text): a row for each line of the files, or for each file."""
    raw = spark.read.text(path, wholetext=whole)
    return raw.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def one_text(spark: SparkSession, *words: str) -> DataFrame:
    """Arguments as one text, apart by blanks."""
    return spark.createDataFrame([(0, " ".join(words))], "doc_id bigint, text string")


def parse_ranges(text: str) -> tuple[ClassRange, ...]:
    """Lines of 'lo hi class_id', decimal, hex or octal; '#' begins a comment. Ranges must not overlap."""
    found = []
    for no, line in enumerate(text.splitlines(), 1):
        parts = line.split("#")[0].split()
        if not parts:
            continue
        if len(parts) != 3:
            raise ValueError(f"line {no}: three numbers")
        lo, hi, c = (int(p, 8) if re.fullmatch(r"0[0-7]+", p) else int(p, 0) for p in parts)
        if not 0 <= lo <= hi <= 0x10FFFF or not 0 <= c <= 255:
            raise ValueError(f"line {no}: out of range")
        found.append(ClassRange(lo, hi, c))
    found.sort(key=lambda r: r.lo)
    for a, b in zip(found, found[1:]):
        if b.lo <= a.hi:
            raise ValueError(f"{b.lo:#x} is in two ranges")
    return tuple(found)


def parse_crf_config(text: str) -> tuple[dict[str, float], dict[int, float], list[str]]:
    """(scalars, weights by feature key, lines that say nothing known) of 'trans00 = x', 'bos_to1 = x' and 'feat t label v1 v2 = w'."""
    scalars, weights, other = {}, {}, []
    for line in text.splitlines():
        line = re.split("[#;]", line)[0].strip()
        if not line:
            continue
        name, _, value = (x.strip() for x in line.partition("="))
        parts = name.split()
        try:
            if parts[:1] == ["feat"] and len(parts) == 5:
                t, y, a, b = (int(p, 0) for p in parts[1:])
                weights[t << 24 | y << 16 | a << 8 | b] = float(value)
            elif name in ("trans00", "trans01", "trans10", "trans11", "bos_to1"):
                scalars[name] = float(value)
            else:
                other.append(line)
        except ValueError:
            other.append(line)
    return scalars, weights, other
