"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's share of the tokens is raised to an exponent between 0 and 1 and all are normalised. The exponent is bisected:
the largest at which the weights' entropy reaches `ENTROPY` of the greatest possible one, but not so small that a source
would be repeated more than `REPEATS` times. The token budget is the one at which the source with the least repetition is
read exactly once, so no document is lost; every other source has a quota of at least its own tokens.

A quota is realised in epochs. Each source is divided into blocks by a hash of its documents: of about `BLOCK` tokens, and `BLOCKS` of them at least.
Whole epochs take every block; the last one walks the blocks in the order of a permutation keyed by source and epoch
and takes them as long as the quota lasts; within a block documents are in the order of a hash keyed by the epoch, and within the one where the quota ends they are
taken in that order while their tokens fit. So a source is never sorted in one place, however large it is.

Tokens are UTF-8 bytes and one for the separator. Defined cases: a null text counts as an empty one; a null source is a
source of its own; rows repeated in full are separate documents of equal place, which the
last epoch takes together, so that it may pass its quota by all but one of them. With one source, or shares that are equal, every document is taken once. An empty table gives an
empty table. Other columns pass unchanged. Only a text's size is read, however long it is. Sources are settled on the driver, a row each; with more than `SOURCES` of them an error is raised.
The pipeline's stage gives each document as often as it is read; the packing after it orders them anew, by size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.core import column, fresh, table

ENTROPY = 0.95
REPEATS = 4.0
BLOCK = 64 << 20
BLOCKS = 64
SEED = 20240607
SOURCES = 1_000_000  # rows of some 30 bytes, a source each


def weights_at(share: np.ndarray, exponent: float) -> np.ndarray:
    w = np.exp(exponent * np.log(share) - (exponent * np.log(share)).max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w * np.log(w)).sum())


def repeats(share: np.ndarray, exponent: float) -> np.ndarray:
    """How often each source is read at this exponent, if the one with the least repetition is read once."""
    r = weights_at(share, exponent) / share
    return r / r.min()


def _bisect(holds, steps: int = 60) -> float:
    """The largest exponent of [0, 1] at which a condition holds that is true up to some exponent; 0 if it never is."""
    if holds(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid)
    return lo


def exponent_for(tokens: np.ndarray, target: float = ENTROPY, most: float = REPEATS) -> float:
    """The exponent for sources of so many tokens each."""
    share = tokens / tokens.sum()
    flat = _bisect(lambda a: entropy(weights_at(share, a)) >= target * np.log(len(share)) - 1e-12)
    few = 1.0 - _bisect(lambda a: repeats(share, 1.0 - a).max() <= most + 1e-12)
    return max(flat, few)


def plan(tokens: np.ndarray, target: float = ENTROPY, most: float = REPEATS) -> np.ndarray:
    """Each source's quota of tokens, at least its own."""
    share = tokens / tokens.sum()
    r = repeats(share, exponent_for(tokens, target, most))
    return np.maximum(np.floor(tokens * r + 0.5), tokens).astype(np.int64)


def mix_sources(docs: DataFrame, target: float = ENTROPY, most: float = REPEATS, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """docs with columns epoch, block, block_order and place added (with underscores where taken): a row for each time that a document is read.

    In an epoch, a source's documents come in the order of (block_order, block, place, doc_id). Where the last epoch ends is a
    row for each source, so the documents themselves are never moved.
    """
    spark = docs.sparkSession
    names = {k: fresh(docs, k) for k in ("epoch", "block", "block_order", "place", "mix_source", "mix_whole", "mix_last", "mix_blocks", "mix_cut", "mix_tokens")}
    c = {k: F.col(v) for k, v in names.items()}
    text, source, doc_id = column(docs, "text"), column(docs, "source"), column(docs, "doc_id")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    # a row a source goes over the driver and to all tasks
    found = docs.groupBy(source.alias("source")).agg(F.sum(size).alias("tokens")).orderBy(F.col("tokens").desc(), F.col("source")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: group them before they are mixed")
    if not found:
        return docs.select("*", F.lit(1).alias(names["epoch"]), F.lit(0).alias(names["block"]), *(F.lit(0).cast("bigint").alias(names[k]) for k in ("block_order", "place")))
    tokens = np.array([r["tokens"] for r in found], np.int64)
    kind = docs.schema["source"].dataType.simpleString()
    rows = [(r["source"], int(q // t), int(q % t), int(max(blocks, -(-t // block)))) for r, q, t in zip(found, plan(tokens, target, most), tokens)]
    sources = spark.createDataFrame(rows, f"{names['mix_source']} {kind}, {names['mix_whole']} int, {names['mix_last']} bigint, {names['mix_blocks']} int")
    key = F.xxhash64(F.lit(SEED), doc_id, F.xxhash64(text), source)

    def placed(by: DataFrame) -> DataFrame:
        joined = docs.join(F.broadcast(by), source.eqNullSafe(c["mix_source"]))
        return joined.withColumns({names["place"]: key, names["mix_tokens"]: size}).withColumn(names["block"], F.pmod(c["place"], c["mix_blocks"]).cast("int"))

    def place(epoch: Column) -> Column:
        return F.xxhash64(c["place"], epoch)

    def order(epoch: Column) -> Column:
        return F.xxhash64(F.lit(SEED), c["mix_source"], epoch, c["block"])

    last = order(c["mix_whole"] + 1)
    # the block in which the last epoch ends, and what is left for it
    sizes = placed(sources).groupBy(*(c[k] for k in ("mix_source", "block", "mix_whole", "mix_last"))).agg(F.sum(c["mix_tokens"]).alias("in_block"))
    walk = Window.partitionBy(c["mix_source"]).orderBy(last, c["block"]).rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumn("before", F.sum("in_block").over(walk) - F.col("in_block")).filter((F.col("before") <= c["mix_last"]) & (c["mix_last"] < F.col("before") + F.col("in_block")))
    at = {tuple([r[0]]): (r[1], r[2], r[3]) for r in ends.select(c["mix_source"], last.alias("o"), c["block"], c["mix_last"] - F.col("before")).collect()}
    cut = f"{names['mix_cut']} struct<o:bigint,block:int,left:bigint>"
    ending = spark.createDataFrame([(*r, at[(r[0],)]) for r in rows], f"{names['mix_source']} {kind}, {names['mix_whole']} int, {names['mix_last']} bigint, {names['mix_blocks']} int, {cut}")
    # within that block: the last document that fits
    id_ = F.struct(F.isnotnull(doc_id).alias("late"), doc_id.alias("id"))
    inner = placed(ending).filter(c["block"] == c["mix_cut"]["block"]).select(c["mix_source"], c["mix_cut"]["left"].alias("left"), c["mix_tokens"].alias("n"), F.struct(place(c["mix_whole"] + 1).alias("place"), id_.alias("id")).alias("at"))
    fits = inner.withColumn("sum", F.sum("n").over(Window.partitionBy(c["mix_source"]).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).filter("sum <= left")
    upto = fits.groupBy(c["mix_source"]).agg(F.max("at").alias("upto"))
    final = ending.join(upto.withColumnRenamed(names["mix_source"], "s"), c["mix_source"].eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("upto", fresh(docs, "mix_upto"))
    upto_ = F.col(fresh(docs, "mix_upto"))
    now, end = F.struct(last.alias("o"), c["block"].alias("block")), F.struct(c["mix_cut"]["o"].alias("o"), c["mix_cut"]["block"].alias("block"))
    taken = (now < end) | ((now == end) & upto_.isNotNull() & (F.struct(place(c["mix_whole"] + 1).alias("place"), id_.alias("id")) <= upto_))
    out = placed(final).withColumn(names["epoch"], F.explode(F.sequence(F.lit(1), c["mix_whole"] + F.when(taken, 1).otherwise(0))))
    return out.withColumns({names["block_order"]: order(c["epoch"]), names["place"]: place(c["epoch"])}).select(*(column(docs, n) for n in docs.columns), *(c[k] for k in ("epoch", "block", "block_order", "place")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's quota has them. Columns as in docs."""
    return mix_sources(docs).select(*(column(docs, n) for n in docs.columns))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document: its source, the epoch, and its place in the epoch's permutation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).drop("text")
