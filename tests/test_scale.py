"""Steps that grew faster than the input or held too much: their work and memory are bounded, and the results are those of the plain definition."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import lattice as L
from lexweave.operators import segment as S
from lexweave.operators import training as R
from lexweave.operators import vocabulary as V
from lexweave.plans import segment_queries as q

ODD = ["", " ", "a", "ab  c\t", "x▁y ▀z", "漢字 かな 。１", "é😀 ￡!", "the cat sat on the mat " * 90, "z" * 2049, "b" * 2048, None]


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(1)
    pieces = sorted({"".join(r.choice(list("abcé漢"), r.integers(1, 5))) for _ in range(80)} | set("abc"))
    logp = np.log(r.dirichlet(np.ones(len(pieces))))
    return L.Model(pieces, R.quantized(logp), {k: int(r.integers(-60, 90)) for k in R.feature_keys().tolist()}, 4, logp=logp)


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(ODD)], "doc_id bigint, line_no bigint, line string")


def text(n, seed=0, letters="abcé漢 1"):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


@pytest.mark.parametrize("n", [1, 3, 4, 7])
def test_nbest_of_long_texts_takes_few_steps(model, monkeypatch, n):
    texts = [text(k, k) for k in (1, 2, 3, 300, 2500, 6000)] + ["a" * 1500]
    found, steps = [], []
    plain = L.Lists.next
    monkeypatch.setattr(L.Lists, "next", lambda self, *a: steps.append(1) or plain(self, *a))
    for long in (10**9, 1024):
        monkeypatch.setattr(L, "LONG", long)
        steps.clear()
        lat = L.Lattice(texts, model.table, 4)
        found.append([[(s, b.tolist()) for s, b in x] for x in L.nbest(lat, lat.joint_scores(model), 128, n)])
    assert found[0] == found[1] and len(steps) <= 2 * L.CHUNK


def test_paths_joined_are_the_tokens(spark, model, lines):
    n = S.nbest_joined(lines, model, 3, "\n").select("line_no", "rank", "score", "n_tokens", "joined")
    want = S.tokenize_nbest(lines, model, 3).select("line_no", F.explode("nbest").alias("b")).select("line_no", "b.rank", "b.score", F.size("b.tokens").cast("bigint"), F.array_join("b.tokens", "\n"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, want.collect()))
    seeded = lines.withColumn("seed", F.col("line_no") * 7919 + 1)
    one = S.one_of_nbest(seeded, model, 3, "\n").select("line_no", "rank", "joined").collect()
    picked = S.tokenize_nbest(seeded.filter("line <> ''"), model, 3).withColumn("b", S.pick_from_nbest(F.col("nbest"), F.col("seed"))).filter("b is not null")
    assert sorted(map(tuple, one)) == sorted(map(tuple, picked.select("line_no", "b.rank", F.array_join("b.tokens", "\n")).collect()))
    two = S.samples_joined(seeded.withColumn("other", F.col("seed") + 5), model, 1.3, {1: "seed", 2: "other"}, "\n").select("line_no", "rep", "score", "joined").collect()
    parts = [S.tokenize_sample(seeded.withColumn("seed", F.col("seed") + 5 * k), model, 1.3).filter("line <> ''").select("line_no", F.lit(k + 1), "score", F.array_join("tokens", "\n")) for k in (0, 1)]
    assert sorted(map(tuple, two)) == sorted(map(tuple, parts[0].union(parts[1]).collect()))
    assert [(r.tokens, r.score) for r in S.tokenize(lines, model).filter("line is null or line = ''").orderBy("line_no").collect()] == [([], 0), (None, None)]


def test_sums_of_paths_once_for_all_draws(model, monkeypatch):
    calls, plain = [], L.forward
    monkeypatch.setattr(L, "forward", lambda *a, **k: calls.append(1) or plain(*a, **k))
    lat = L.Lattice([text(50), text(90)], model.table, 4)
    mark, layer, row, score = L.drawn_marks(lat, model, 1.0, np.arange(1, 7), np.array([0, 1, 0, 1, 1, 0]))
    assert len(calls) == 1 and mark.shape[0] == 3 and len(score) == 6


def test_uses_of_long_texts(model, monkeypatch):
    lat = L.Lattice([text(n, n, "abc") for n in (5, 0, 700, 3000)], model.table, 4)
    found = []
    for steps in (1 << 14, 10):
        monkeypatch.setattr(L, "STEPS", steps)
        found.append(L.expected_counts(lat, model.logp))
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1:], found[1][1:]) and found[0][2] == 3


def test_trie_and_hashes_find_the_same(model, monkeypatch):
    a = L.Lattice([text(400), "", "zz"], model.table, 4).ids
    monkeypatch.setattr(L.PieceTable, "DENSE", 0)
    assert np.array_equal(a, L.Lattice([text(400), "", "zz"], L.PieceTable(model.pieces), 4).ids)


def test_gold_strings_are_gold_sequences(lines):
    want = R.gold_sequences(lines, of=T.gold_class).select("doc_id", "line_no", F.array_join("y", ""), F.array_join("cls", ",")).collect()
    assert sorted(map(tuple, R.gold_strings(lines).collect())) == sorted(map(tuple, want))
    assert np.array_equal(R.gold_classes(np.arange(0x10000, dtype=np.uint32))[0x3400:0x3410], np.full(16, 6))


def test_one_pass_keeps_nothing(spark, lines, monkeypatch):
    kept = []
    plain = type(lines).persist
    monkeypatch.setattr(type(lines), "persist", lambda self, *a: kept.append(1) or plain(self, *a))
    config = R.TrainConfig(crf_opt="sgd", crf_epochs=1)
    a = R.crf_fit(lines, R.CrfWeights.preset(), config)
    assert not kept
    b = R.crf_fit(R.gold_sequences(lines), R.CrfWeights.preset(), R.TrainConfig(crf_opt="sgd", crf_epochs=1))
    assert np.allclose(a.feat, b.feat) and np.allclose(a.trans, b.trans)


def test_blocks_of_characters_bound_a_count(lines, monkeypatch):
    most, plain = [], V._starts
    monkeypatch.setattr(V, "_starts", lambda points, f: most.append(len(points)) or plain(points, f))
    monkeypatch.setattr(V, "map_arrow", lambda df, f, schema: made.extend(x for x in f([pa.record_batch([pa.array([r.line for r in df.collect()])], ["line"])])) or df.sparkSession.createDataFrame([], schema))
    monkeypatch.setattr(V, "BLOCK", 3000)
    made: list[pa.RecordBatch] = []
    V.ngram_counts(lines, 2, 8, 1)
    assert max(most) < 2 * 3000 and len(most) > 1
    got = {}
    for b in made:
        for n, piece, c in zip(*(x.to_pylist() for x in b.columns)):
            got[piece] = got.get(piece, 0) + c
    want = {}
    for t in filter(None, ODD):
        for n in range(2, 9):
            for k in range(len(t) - n + 1):
                p = t[k : k + n]
                if not set(p) & set("\0\t\r\n ") and not (p[0] < "\x7f" and not p[0].isalnum()):
                    want[p] = want.get(p, 0) + 1
    assert got == want


@pytest.mark.parametrize("frequent", [10**6, 2])
def test_backoff_both_ways(spark, frequent, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, q._backoff_by_joins(spark, sf).select("by", "n", "sum_score").collect()))
    monkeypatch.setattr(q, "FREQUENT", frequent)
    assert sorted(map(tuple, q.bigram_backoff(spark, sf).select("by", "n", "sum_score").collect())) == want and len(want) == 3


def test_codec_without_escapes_needs_no_expression(spark):
    df = spark.createDataFrame([("a b\tc\r\n",), ("▀▀▁ ▄",), ("x▁y ▀z",), ("▀",), ("",), (None,), ("﷐▁b",), ("﷐▀▁",)], "t string")
    rows = df.select("t", T.lossless_encode(F.col("t")).alias("e"), T.lossless_decode(F.col("t")).alias("d"), T.lossless_decode(T.lossless_encode(F.col("t"))).alias("r")).collect()
    assert all(r.t == r.r for r in rows) and rows[0].e == "a▁b▂c▄▃" and rows[6].d == "﷐ b" and rows[7].d == "﷐▁" and rows[2].d == "x y z"
