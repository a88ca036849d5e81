"""The command-line tools' work as transforms of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import detok_line, lossless_decode, lossless_encode
from lexweave.functions.utf8 import normalize_utf8
from lexweave.operators import lattice as L
from lexweave.operators import segment as S
from lexweave.sources.corpus import tokenizer_lines


def tokenize_df(docs: DataFrame, model: L.Model, *, max_line_bytes: int = 16384, lossless_ws: bool | None = None, normalize: bool = True, fallback_char: str = "?", read_all: bool = False, sample: bool = False, temperature: float = 1.0, seed: int = 1, nsamples: int = 1, nbest: int = 0, sample_nbest: bool = False) -> DataFrame:
    """(doc_id, line_no, rep, rank, score, tokens): the lines of docs, or with read_all each text whole, segmented.

    One row for the best path, or for each of nbest or nsamples; sample_nbest draws nsamples of the nbest with equal chances.
    White space is encoded where lossless_ws says so or, if it is None, the model. The text may be binary; normalize makes valid UTF-8 of it
    and of strings that aren't, with fallback_char for what can't be read. Seeds are made of (seed, doc_id, line_no, rep), so the result doesn't hang on the order of rows.
    """
    if normalize:
        docs = docs.withColumn("text", normalize_utf8(F.col("text").cast("binary"), fallback_char))
    elif dict(docs.dtypes)["text"] == "binary":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    if read_all:
        lines = docs.select("doc_id", F.lit(0).cast("bigint").alias("line_no"), F.col("text").alias("line"))
    else:
        lines = tokenizer_lines(docs, max_line_bytes)
    if model.lossless_ws if lossless_ws is None else lossless_ws:
        lines = lines.withColumn("line", lossless_encode(F.col("line")))
    zero = F.lit(0)
    columns = ("doc_id", "line_no", "rep", "rank", "score", "tokens")
    if nbest > 0:
        found = S.tokenize_nbest(lines, model, nbest)
        if not sample_nbest:
            return found.select("doc_id", "line_no", zero.alias("rep"), F.explode("nbest").alias("b")).select("doc_id", "line_no", "rep", "b.rank", "b.score", "b.tokens")
        each = found.withColumn("rep", F.explode(F.sequence(zero, F.lit(nsamples - 1))))
        picked = each.withColumn("b", S.pick_from_nbest(F.col("nbest"), S.seed_of(seed, F.col("doc_id"), F.col("line_no"), F.col("rep"))))
        return picked.select("doc_id", "line_no", "rep", "b.rank", "b.score", "b.tokens")
    if sample:
        each = lines.withColumn("rep", F.explode(F.sequence(zero, F.lit(nsamples - 1)))).withColumn("seed", S.seed_of(seed, F.col("doc_id"), F.col("line_no"), F.col("rep")))
        return S.tokenize_sample(each, model, temperature).withColumn("rank", zero).select(*columns)
    return S.tokenize(lines, model).withColumns({"rep": zero, "rank": zero}).select(*columns)


def token_lines(tokenized: DataFrame) -> DataFrame:
    """(value) of tokens apart by blanks, for write.text; tokens may be joined so already."""
    return tokenized.select((F.col("joined") if "joined" in tokenized.columns else F.array_join("tokens", " ")).alias("value"))


def detokenize_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.withColumn(line, detok_line(F.col(line)))


def detokenize_df(tokenized: DataFrame) -> DataFrame:
    """tokenized with the text that its tokens, or these joined, were made of; exact for read_all with lossless_ws."""
    return tokenized.withColumn("text", lossless_decode(F.col("joined") if "joined" in tokenized.columns else F.array_join("tokens", "")))
