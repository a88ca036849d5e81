"""Training, segmentation and streams end to end."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.model import SegmenterModel
from lexweave.functions.text import ClassRange
from lexweave.operators import lattice as L
from lexweave.operators import pipeline as P
from lexweave.operators import segment as S
from lexweave.operators import training as R
from lexweave.operators import vocabulary as V
from lexweave.sources import corpus as C
from lexweave.streaming import segment as stream

CONFIG = R.TrainConfig(vocab=300, max_piece_len=4, iters=3, min_count=5, char_vocab=256, cand_total=2000)
SAMPLE = [(k, "the cat sat on the mat\nthe dog sat too  \n\t日本語 の テスト " + "ab" * (k % 5)) for k in range(60)] + [(100, ""), (101, None), (102, "x▁y ▀z\r\n\tq")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SAMPLE, "doc_id bigint, text string").persist()


@pytest.fixture(scope="module")
def trained(docs):
    return R.train(docs, CONFIG)


def test_training(trained):
    model, history = trained
    assert len(history) == 3 and history[-1].vocab <= 300
    assert len(model.pieces) == len(set(model.pieces)) == len(model.logp_q)
    assert "the" in model.pieces or "at" in model.pieces


def test_em_goes_up_without_pruning(docs):
    lines, first = R.induce(docs, CONFIG)
    out, history = R.em_train(lines, first, R.TrainConfig(vocab=0, max_piece_len=4, iters=4, mdl_lambda_len=0.0))
    assert all(b.loglik >= a.loglik - 1e-6 for a, b in zip(history, history[1:]))
    assert abs(out.agg(F.sum(F.exp("logp"))).first()[0] - 1) < 1e-9


def test_no_cover(spark, docs):
    lines, first = R.induce(docs, CONFIG)
    with pytest.raises(R.NoCover, match="t"):
        R.em_train(lines, first.filter("not contains(piece, 't')").drop("piece_id").withColumn("piece_id", F.monotonically_increasing_id()), CONFIG)


def test_read_all_round_trip(docs, trained):
    found = P.detokenize_df(P.tokenize_df(docs, trained[0], lossless_ws=True, read_all=True))
    assert {(r.doc_id, r.text) for r in found.collect()} == {(d, t) for d, t in SAMPLE}


def test_modes(docs, trained):
    m = trained[0]
    one = P.tokenize_df(docs, m)
    assert one.filter("size(tokens) = 0").count() == 0
    several = P.tokenize_df(docs, m, nbest=3).collect()
    best = {(r.doc_id, r.line_no): r for r in one.collect()}
    assert all(r.score == best[r.doc_id, r.line_no].score and r.tokens == best[r.doc_id, r.line_no].tokens for r in several if r.rank == 0)
    drawn = lambda: sorted(map(tuple, P.tokenize_df(docs.repartition(3), m, sample=True, nsamples=2, seed=5).select("doc_id", "line_no", "rep", F.array_join("tokens", "|")).collect()))
    assert drawn() == drawn()
    assert P.tokenize_df(docs, m, nbest=3, sample_nbest=True, nsamples=2).count() == 2 * one.count()
    assert P.token_lines(one).columns == ["value"]


def test_supervised_crf_learns(spark):
    gold = spark.createDataFrame([("東京 都 12 ab",), ("ab 12 東京",), ("a 1",), ("",)] * 5, "line string")
    seq = R.gold_sequences(gold)
    assert seq.count() == 15 and seq.first().y == [1, 0, 1, 1, 0, 1, 0] and seq.first().cls[:3] == [6, 6, 6]
    start = R.CrfWeights.preset()
    for opt in ("lbfgs", "sgd"):
        got = R.crf_fit(seq, start, R.TrainConfig(crf_opt=opt, crf_epochs=5))
        assert R.crf_pass(seq, got)[2] > R.crf_pass(seq, start)[2] and got.bos == start.bos


def test_model_object(spark, docs, trained, tmp_path):
    m = SegmenterModel(spark, trained[0])
    m.save(str(tmp_path / "m"))
    again = SegmenterModel.load(spark, str(tmp_path / "m"))
    rows = docs.select("text", m.tokenize(F.col("text")).alias("a"), again.tokenize(F.col("text")).alias("b"), m.nbest(F.col("text"), 2).alias("n"), m.sample(F.col("text"), 1.0, 3).alias("s"), m.tokenize_with_offsets(F.col("text"), "byte").alias("o")).collect()
    for r in rows:
        assert r.a == r.b and (r.text is None) == (r.a is None)
        if r.text:
            assert "".join(r.a) == r.text == "".join(r.s) and r.n[0].tokens == r.a
            assert r.o[-1].end == len(r.text.encode()) and [x.token for x in r.o] == r.a
        elif r.text == "":
            assert r.a == []
    m.register()
    assert spark.sql("select nbest8('the cat') n").first().n[0].tokens == spark.sql("select tokenize('the cat') t").first().t
    docs.createOrReplaceTempView("texts")
    assert spark.sql("select size(tokenize(text)) n from texts where doc_id = 1").first().n > 0
    assert spark.sql("select t.doc_id, b.rank, b.score from texts t, lateral nbest_rows(t.text, 2) b where t.doc_id = 3").count() == 2
    with pytest.raises(ValueError):
        m.nbest(F.col("text"), 65)
    with pytest.raises(ValueError):
        m.tokenize_with_offsets(F.col("text"), "lines")


def test_bigram_models_segment(spark, docs, trained):
    import copy

    m = copy.copy(trained[0])
    r = np.random.default_rng(1)
    m.bigrams = {(int(a), int(b)): int(q) for a, b, q in zip(r.choice([L.BOS_ID, *range(len(m.pieces))], 400), r.integers(0, len(m.pieces), 400), r.integers(-900, 900, 400))}
    lines = C.corpus_lines(docs)
    assert S.tokenize(lines, m).filter("array_join(tokens, '') <> line").count() == 0
    best = {(x.doc_id, x.line_no): (x.score, x.tokens) for x in S.tokenize(lines, m).collect()}
    several = {(x.doc_id, x.line_no): (x.nbest[0].score, x.nbest[0].tokens) for x in S.tokenize_nbest(lines, m, 3).collect()}
    assert best == several


def test_texts_of_other_bytes(spark, trained):
    d = spark.createDataFrame([(1, b"the \xff cat\nsat\xe3\x81"), (2, "日本語".encode())], "doc_id bigint, text binary")
    got = {(r.doc_id, r.line_no): "".join(r.tokens) for r in P.tokenize_df(d, trained[0], fallback_char="#").collect()}
    assert got == {(1, 0): "the # cat", (1, 1): "sat##", (2, 0): "日本語"}
    plain = {(r.doc_id, r.line_no): "".join(r.tokens) for r in P.tokenize_df(d.filter("doc_id = 2"), trained[0], normalize=False).collect()}
    assert plain == {(2, 0): "日本語"}


def test_classes_and_flags_go_with_the_model(spark, docs, tmp_path):
    ranges = (ClassRange(0x3040, 0x30FF, 4), ClassRange(0x4E00, 0x9FFF, 6))
    config = replace(CONFIG, lossless_ws=True, lossless_eol=True, cc_mode="ranges", cc_ranges=ranges, iters=1)
    model, _ = R.train(docs, config)
    assert "▃" in model.pieces and model.lossless_ws and model.cc_ranges == ranges
    m = SegmenterModel(spark, model)
    for at in (str(tmp_path / "m"), str(tmp_path / "m.bin")):
        m.save(at)
        again = SegmenterModel.load(spark, at).model
        assert (again.lossless_ws, again.cc_mode, again.cc_ranges, again.cc_fallback) == (True, "ranges", ranges, "utf8len")
        found = P.detokenize_df(P.tokenize_df(docs, again, read_all=True))
        assert {(r.doc_id, r.text) for r in found.collect()} == {(d, t) for d, t in SAMPLE}


def test_spread_runs_no_job_and_leaves_streams(spark, docs, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    out = C.spread(C.spread(C.corpus_lines(docs)).groupBy("doc_id").count())
    assert len(tracker.getJobIdsForGroup(None)) == before
    (tmp_path / "in").mkdir()
    assert C.spread(stream.text_stream(spark, str(tmp_path / "in"))).isStreaming
    assert out.count() == 61


def test_boundary_scores(spark):
    found = spark.createDataFrame([(1, ["ab", "c", "d"])], "k bigint, tokens array<string>")
    gold = spark.createDataFrame([(1, ["a", "bc", "d"])], "k bigint, tokens array<string>")
    r = S.boundary_scores(found, gold, ["k"]).first()
    assert (r.precision, r.recall, r.tokens_per_sentence) == (2 / 3, 2 / 3, 3.0) and abs(r.token_length - 4 / 3) < 1e-9


@pytest.mark.parametrize("budget", [0, 1, 57, 1000, 5400, 10**9])
def test_byte_budget_by_hand(spark, budget):
    rows = [(d * d * 7919 - 10**6, n, "x" * (d % 13)) for d in range(200) for n in range(d % 4)] + [(10**12, 0, "y" * 900)]
    want, used = [], 0
    for r in sorted(rows):
        if used < budget:
            want.append(r)
        used += len(r[2]) + 1
    for kind in ("bigint", "string"):
        d = spark.createDataFrame(rows, "doc_id bigint, line_no bigint, line string")
        if kind == "string":
            d = d.withColumn("doc_id", F.format_string("%020d", F.col("doc_id") + 10**7))
        assert sorted(r.line for r in V.byte_budget(d, budget).collect()) == sorted(x for *_, x in want)
    assert V._last_needed(d.filter("false").withColumn("bytes", F.lit(1)), 5) is None


def test_keep_chars(spark):
    assert V.char_vocab_size(6000, 8000) == 6000 and V.char_vocab_size(8000, 1000) == 500 and V.char_vocab_size(300, 300) == 299 and V.char_vocab_size(10, 0) == 256
    lines = spark.createDataFrame([(1, 0, "a漢漢字é")], "doc_id bigint, line_no bigint, line string")
    keep = V.keep_chars(V.codepoint_counts(lines), 97)
    assert {r.ch for r in keep.collect()} - {chr(c) for c in range(32, 127)} == {"漢", "é"}
    assert V.map_rare(lines, keep).first().line == "a漢漢?é"


def test_ngrams(spark):
    lines = spark.createDataFrame([(1, 0, "aaaa b.c"), (1, 1, "?aa")], "doc_id bigint, line_no bigint, line string")
    got = {(r.piece): r.cnt for r in V.ngram_counts(lines, 2, 3, 1, "?").collect()}
    assert got == {"aa": 4, "aaa": 2, "b.": 1, "b.c": 1}


def test_stream(spark, docs, trained, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat\nsat\n")
    s = stream.segment_stream(stream.text_stream(spark, str(tmp_path / "in")), SegmenterModel(spark, trained[0]))
    stream.write_segments(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted("".join(r.tokens) for r in got) == ["sat", "the cat"]


def test_quantized():
    assert R.quantized([0.2, 1e9]).tolist() == [51, 32767] and np.array_equal(R.feature_keys(), np.unique(R.feature_keys())) and len(R.feature_keys()) == 418
