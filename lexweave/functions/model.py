"""A trained model as an object over DataFrames, and as functions of SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import lattice as L
from lexweave.operators import segment as S
from lexweave.operators.training import TrainConfig, train
from lexweave.ship import ship
from lexweave.sources import model_store


NBEST = "array<struct<rank:int,score:bigint,tokens:array<string>>>"


class SegmenterModel:
    """Segmentation of columns of text. A null text gives null, an empty one no tokens."""

    def __init__(self, spark: SparkSession, model: L.Model) -> None:
        self.spark, self.model = spark, model
        ship(spark)
        self._shared = spark.sparkContext.broadcast(model)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SegmenterModel:
        """From the Parquet tables under path, or a binary file that ends in .bin."""
        if path.endswith(".bin"):
            with open(path, "rb") as f:
                return cls(spark, model_store.from_bytes(f.read()))
        return cls(spark, model_store.load(spark, path))

    @classmethod
    def train(cls, docs: DataFrame, config: TrainConfig = TrainConfig(), **more) -> SegmenterModel:
        return cls(docs.sparkSession, train(docs, config, **more)[0])

    def save(self, path: str) -> None:
        """As Parquet tables under path, or as a binary file where it ends in .bin."""
        if path.endswith(".bin"):
            with open(path, "wb") as f:
                f.write(model_store.to_bytes(self.model))
            return
        model_store.save(self.model, self.spark, path)

    def __repr__(self) -> str:
        return f"SegmenterModel({len(self.model.pieces)} pieces of {self.model.max_len} characters at most)"

    def tokenize(self, text: Column) -> Column:
        return self._udf("array<string>", lambda m, texts: _best(m, texts))(text)

    def tokenize_with_offsets(self, text: Column, unit: str = "char") -> Column:
        return S.with_offsets(self.tokenize(text), unit)

    def nbest(self, text: Column, n: int = 8) -> Column:
        """The n best segmentations as an array of (rank, score, tokens)."""
        return self._nbest(n)(text)

    def _nbest(self, n: int):
        if n > S.MAX_NBEST:
            raise ValueError(f"n-best of {n}: {S.MAX_NBEST} at most")

        def work(m: L.Model, texts: list[str]) -> list:
            lat = L.Lattice(texts, m.table, m.max_len)
            found = L.best_n(lat, m, max(1, n))
            return [[{"rank": r, "score": s, "tokens": S._tokens(t, b)} for r, (s, b) in enumerate(f)] for t, f in zip(texts, found)]

        return self._udf(NBEST, work, L.batch_for(n))

    def sample(self, text: Column, temperature: float = 1.0, seed: Column | int = 1) -> Column:
        """Tokens drawn with a seed; a number stands for a seed of each text's own that depends on both."""
        shared = self._shared
        seeds = S.seed_of(seed, text) if isinstance(seed, int) else seed

        @F.pandas_udf("array<string>")
        def draw(texts: pd.Series, seed_: pd.Series) -> pd.Series:
            out: list = [None if t is None else [] for t in texts]
            some = [k for k, t in enumerate(texts) if t]
            for part in L.batches([texts.iloc[k] for k in some]):
                rows = [some[k] for k in part]
                here = [texts.iloc[k] for k in rows]
                m = shared.value
                lat = L.Lattice(here, m.table, m.max_len)
                bounds, _ = L.drawn_paths(lat, m, temperature, seed_.iloc[rows].to_numpy().astype("int64").astype("uint32"))
                for k, t, b in zip(rows, here, bounds):
                    out[k] = S._tokens(t, b)
            return pd.Series(out)

        return draw(text, seeds)

    def _udf(self, kind: str, work, most: int = L.BATCH):
        shared = self._shared

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = shared.value
            for texts in batches:
                out: list = [None if t is None else [] for t in texts]
                some = [k for k, t in enumerate(texts) if t]
                for part in L.batches([texts.iloc[k] for k in some], most):
                    rows = [some[k] for k in part]
                    for k, v in zip(rows, work(m, [texts.iloc[k] for k in rows])):
                        out[k] = v
                yield pd.Series(out)

        return run

    def register(self, prefix: str = "") -> None:
        """tokenize(text), nbest8(text) as SQL functions, and nbest_rows(text, n) as a table function for LATERAL."""
        shared = self._shared
        self.spark.udf.register(f"{prefix}tokenize", self._udf("array<string>", lambda m, texts: _best(m, texts)))
        self.spark.udf.register(f"{prefix}nbest8", self._nbest(8))

        class NbestRows:
            def eval(self, text: str, n: int):
                if not text:
                    return
                m = shared.value
                lat = L.Lattice([text], m.table, m.max_len)
                for rank, (score, bounds) in enumerate(L.best_n(lat, m, min(max(1, n), S.MAX_NBEST))[0]):
                    yield rank, int(score), S._tokens(text, bounds)

        self.spark.udtf.register(f"{prefix}nbest_rows", F.udtf(NbestRows, returnType="rank int, score bigint, tokens array<string>"))

    def describe(self) -> str:
        return json.dumps({s: getattr(self.model, s) for s in (*model_store.SCALARS, "flags", "cc_mode", "cc_fallback")} | {"ranges": [[r.lo, r.hi, r.class_id] for r in self.model.cc_ranges], "pieces": len(self.model.pieces), "features": len(self.model.crf), "bigrams": len(self.model.bigrams)})


def _best(m: L.Model, texts: list[str]) -> list[list[str]]:
    lat = L.Lattice(texts, m.table, m.max_len)
    bounds, _ = L.best_paths(lat, m)
    return [S._tokens(t, b) for t, b in zip(texts, bounds)]
