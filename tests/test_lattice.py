"""Lattices, training steps and model files against enumeration."""

import collections
import math
import random
from dataclasses import replace

import numpy as np
import pytest

from lexweave.functions.text import ClassRange
from lexweave.operators import lattice as L
from lexweave.operators import training as R
from lexweave.sources import model_store


def segmentations(n, most):
    if n == 0:
        yield []
        return
    for k in range(1, min(most, n) + 1):
        for rest in segmentations(n - k, most):
            yield [k, *rest]


def path_scores(m, x):
    """Every path's (score, lengths) by the definition."""
    c = L.classes(L.code_points([x])[0]).astype(int).tolist()
    before, after, e = [12, *c[:-1]], [*c[1:], 13], m.emit
    out = []
    for cut in segmentations(len(x), m.max_len):
        total, p, last = m.bos_to1, 0, L.BOS_ID
        for k in cut:
            w = x[p : p + k]
            known = w in m.pieces
            lm = int(m.logp_q[m.pieces.index(w)]) if known else max(-32768, m.unk_base + m.unk_per_cp * k)
            if known and last is not None:
                lm = m.bigrams.get((last, m.pieces.index(w)), lm)
            last = m.pieces.index(w) if known else None
            total += int(e[1, before[p], c[p], after[p]]) + (m.lambda0 * lm >> 8)
            total += m.trans11 if k == 1 else m.trans10 + sum(int(e[0, before[q], c[q], after[q]]) for q in range(p + 1, p + k)) + (k - 2) * m.trans00 + m.trans01
            p += k
        out.append((total, cut))
    return out


def test_golden():
    m = L.Model([], np.zeros(0, np.int64), R.CrfWeights.preset().quantized(), 2)
    assert R.CrfWeights.preset().scalars() == {"trans00": 51, "trans01": -102, "trans10": 0, "trans11": -154, "bos_to1": 128}
    lat = L.Lattice(["a1"], m.table, 2)
    found = L.nbest(lat, lat.joint_scores(m), m.bos_to1, 5)[0]
    assert [(s, b.tolist()) for s, b in found] == [(-1203, [0, 2]), (-2740, [0, 1, 2])]


@pytest.mark.parametrize("bigrams", [False, True])
def test_best_paths(bigrams):
    r = random.Random(1)
    for _ in range(80):
        most = r.choice([1, 2, 3, 4])
        pieces = sorted({"".join(r.choice("ab1あ。") for _ in range(r.randrange(1, most + 1))) for _ in range(r.randrange(1, 12))})
        m = L.Model(pieces, np.array([r.randrange(-3000, 0) for _ in pieces], np.int64), {k: r.choice([-20, 0, 30, 100]) for k in R.feature_keys().tolist()}, most, lambda0=r.choice([0, 13, 256]))
        if bigrams:
            m.bigrams = {(r.choice([L.BOS_ID, *range(len(pieces))]), r.randrange(len(pieces))): r.randrange(-2000, 500) for _ in range(12)}
        texts = ["".join(r.choice("ab1あ。") for _ in range(r.randrange(1, 9))) for _ in range(5)]
        lat = L.Lattice(texts, m.table, most)
        scores = lat.joint_scores(m)
        two, value2 = L.bigram_viterbi(lat, scores, m)
        for k, x in enumerate(texts):
            assert value2[k] == max(path_scores(m, x))[0]
        several = L.bigram_nbest(lat, scores, m, 4)
        for k, x in enumerate(texts):
            of = {tuple(np.cumsum([0, *cut]).tolist()): v for v, cut in path_scores(m, x)}
            assert [v for v, _ in several[k]] == sorted(of.values(), reverse=True)[:4] and several[k][0][1].tolist() == two[k].tolist()
            assert all(of[tuple(b.tolist())] == v for v, b in several[k]) and len({tuple(b.tolist()) for _, b in several[k]}) == len(several[k])
        if bigrams:
            continue
        one, value = L.viterbi(lat, scores, m.bos_to1)
        several = L.nbest(lat, scores, m.bos_to1, 4)
        for k, x in enumerate(texts):
            paths = path_scores(m, x)
            assert value[k] == value2[k] and one[k].tolist() == two[k].tolist() == several[k][0][1].tolist()
            assert [s for s, _ in several[k]] == sorted((s for s, _ in paths), reverse=True)[:4]
            assert len({tuple(b.tolist()) for _, b in several[k]}) == len(several[k])


def test_lm_path_takes_the_earliest_start():
    pieces, lp = ["a", "aa"], np.log([0.25, 0.0625])
    lat = L.Lattice(["aaa", "axa", ""], L.PieceTable(pieces), 2)
    bounds, score = L.viterbi(lat, lat.lm_scores(lp), 0.0, longest_wins=True)
    assert bounds[0].tolist() == [0, 1, 3] and bounds[1] is None and bounds[2].tolist() == [0]


def test_expected_counts():
    r = random.Random(1)
    for t in range(30):
        pieces = sorted(set("ab") | {"".join(r.choice("ab") for _ in range(r.randrange(2, 4))) for _ in range(4)})
        lp = np.log(np.random.default_rng(t).dirichlet(np.ones(len(pieces))))
        texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 8))) for _ in range(4)] + ["axb"]
        lat = L.Lattice(texts, L.PieceTable(pieces), 3)
        got, ll, n, tokens, missed = L.expected_counts(lat, lp)
        want, want_ll = np.zeros(len(pieces)), 0.0
        for x in texts[:-1]:
            paths = []
            for cut in segmentations(len(x), 3):
                ends = np.cumsum([0, *cut])
                words = [x[a:b] for a, b in zip(ends, ends[1:])]
                if all(w in pieces for w in words):
                    ids = [pieces.index(w) for w in words]
                    paths.append((math.exp(sum(lp[i] for i in ids)), ids))
            z = sum(p for p, _ in paths)
            want_ll += math.log(z)
            for p, ids in paths:
                for i in ids:
                    want[i] += p / z
        assert np.allclose(got, want) and abs(ll - want_ll) < 1e-9 and (n, missed) == (4, 1) and abs(tokens - want.sum()) < 1e-9


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    w = R.CrfWeights(rng.normal(0, 0.3, 418), rng.normal(0, 0.3, 4))
    size = [5, 0, 1, 7, 3]
    offs = np.r_[0, np.cumsum(size)]
    cls, y = rng.integers(0, 9, offs[-1]), rng.integers(0, 2, offs[-1])
    y[offs[:-1][np.array(size) > 0]] = 1
    g, t, ll, n = R.crf_gradient(cls, y, offs, w)
    v = np.r_[w.feat, w.trans]
    at = lambda u: R.crf_gradient(cls, y, offs, R.CrfWeights(u[:-4], u[-4:]))[2]
    step = 1e-5 * np.eye(422)
    num = np.array([(at(v + s) - at(v - s)) / 2e-5 for s in step])
    assert np.abs(num - np.r_[g, t]).max() < 1e-6 and n == 16 and ll < 0


def test_lbfgs():
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (6, 6))
    a = a @ a.T + np.eye(6)
    b = rng.normal(0, 1, 6)
    x = R.lbfgs(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(6), 60, 5, 1e-8)
    assert np.allclose(a @ x, b, atol=1e-6)


def test_sampling_frequencies():
    m = L.Model(["a", "b", "ab"], np.array([-300, -200, -400]), R.CrfWeights.preset().quantized(), 2)
    n = 20000
    lat = L.Lattice(["abab"] * n, m.table, 2)
    bounds, score = L.sample(lat, lat.joint_scores(m), m.bos_to1, 2.0, np.arange(1, n + 1) * 7919)
    seen = collections.Counter(tuple(b.tolist()) for b in bounds)
    paths = path_scores(m, "abab")
    z = sum(math.exp(s / 512) for s, _ in paths)
    for s, cut in paths:
        assert abs(seen[tuple(np.cumsum([0, *cut]).tolist())] / n - math.exp(s / 512) / z) < 0.015
    of = {tuple(np.cumsum([0, *cut]).tolist()): s for s, cut in paths}
    assert all(of[tuple(b.tolist())] == s for b, s in zip(bounds[:200], score[:200]))


def test_generator():
    assert L.xorshift32(np.array([1], np.uint32))[0] == 270369


@pytest.mark.parametrize("mode", L.MODES)
def test_classes_are_those_of_the_column_function(spark, mode):
    from pyspark.sql import functions as F

    from lexweave.functions.text import ClassRange, char_class

    ranges = (ClassRange(0x61, 0x7A, 77), ClassRange(0xC0, 0x17F, 3), ClassRange(0x3000, 0x303F, 0), ClassRange(0x3040, 0x30FF, 20))
    points = [*range(0, 0x400), *range(0x2570, 0x2590), *range(0x2FF0, 0x3100), 0x4E00, 0x9FFF, 0xFF00, 0xFFEF, 0xFFF0, 0x1F600]
    for fallback in ("utf8len", "ascii"):
        got = L.classes(np.array(points, np.uint32), mode, ranges, fallback).tolist()
        want = spark.createDataFrame([(c,) for c in points], "cp int").select("cp", char_class(F.col("cp"), mode, ranges, fallback).alias("c")).collect()
        assert dict(zip(points, got)) == dict(map(tuple, want))


def test_long_texts_as_in_short_steps(monkeypatch):
    r = random.Random(4)
    pieces = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)})
    lp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces))))
    m = L.Model(pieces, R.quantized(lp), {k: r.choice([-20, 0, 30, 100]) for k in R.feature_keys().tolist()}, 5, logp=lp)
    texts = ["".join(r.choice("abc 1") for _ in range(n)) for n in (1, 7, 40, 41, 120, 997, 3000, 64, 65)] + ["abcab" * 300, "x" * 70]
    found = []
    for long in (10**9, 16):
        monkeypatch.setattr(L, "LONG", long)
        monkeypatch.setattr(L, "CHUNK", 32)
        lat = L.Lattice(texts, m.table, 5)
        scores, lm = lat.joint_scores(m), lat.lm_scores(lp)
        one, two = L.viterbi(lat, scores, m.bos_to1), L.viterbi(lat, lm, 0.0, longest_wins=True)
        counts = L.expected_counts(lat, lp)
        drawn = L.sample(lat, scores, m.bos_to1, 1.5, np.arange(len(texts)))
        found.append((one, two, counts, drawn))
    a, b = found
    assert a[0][1].tolist() == b[0][1].tolist() and [x.tolist() for x in a[0][0]] == [x.tolist() for x in b[0][0]]
    assert np.allclose(np.nan_to_num(a[1][1], neginf=-1e9), np.nan_to_num(b[1][1], neginf=-1e9)) and [x is None for x in a[1][0]] == [x is None for x in b[1][0]] and any(x is not None and x[-1] > 1000 for x in b[1][0])
    assert np.allclose(a[2][0], b[2][0]) and np.allclose(a[2][1:], b[2][1:])
    assert [x.tolist() for x in a[3][0]] == [x.tolist() for x in b[3][0]]


def plain_draw(m, x, temperature, seed):
    """A path drawn over states (place, last length), one number at a time, by the definition."""
    lat = L.Lattice([x], m.table, m.max_len)
    scores, n, top = lat.joint_scores(m), len(x), m.max_len
    ids = lambda p, k: int(lat.ids[k - 1, p])

    def edge(p, k, j):
        prev = L.BOS_ID if j == 0 else ids(p - k, j)
        cur, lm = ids(p, k), 0
        if cur >= 0 and prev >= 0 and (prev, cur) in m.bigrams:
            lm = (m.lambda0 * m.bigrams[prev, cur] >> 8) - (m.lambda0 * int(m.logp_q[cur]) >> 8)
        return int(scores[k - 1, p]) + lm

    alpha = {(0, 0): m.bos_to1 / 256 / temperature}
    for p in range(1, n + 1):
        for k in range(1, min(top, p) + 1):
            parts = [alpha[p - k, j] + edge(p, k, j) / 256 / temperature for j in range(top + 1) if (p - k, j) in alpha]
            alpha[p, k] = max(parts) + math.log(sum(math.exp(v - max(parts)) for v in parts))

    def draw(options):
        nonlocal seed
        seed = int(L.xorshift32(np.array([seed or 0x12345678], np.uint32))[0])
        u, acc = (seed >> 8) / (1 << 24) * sum(w for _, w in options), 0.0
        for v, w in options:
            acc += w
            if u <= acc:
                return v
        return options[-1][0]

    ends = [alpha[n, k] for k in range(1, min(top, n) + 1)]
    k, p, out = draw([(k, math.exp(alpha[n, k] - max(ends))) for k in range(1, min(top, n) + 1)]), n, [n]
    while p - k:
        q = p - k
        lw = {j: alpha[q, j] + edge(p, k, j) / 256 / temperature for j in range(1, min(top, q) + 1)}
        p, k = q, draw([(j, math.exp(v - max(lw.values()))) for j, v in lw.items()])
        out.append(p)
    return [0, *out[::-1]]


@pytest.mark.parametrize("bigrams", [False, True])
def test_drawn_paths_by_their_seeds(bigrams):
    r = random.Random(7)
    pieces = sorted({"".join(r.choice("ab1") for _ in range(r.randrange(1, 4))) for _ in range(12)})
    m = L.Model(pieces, np.array([r.randrange(-900, 0) for _ in pieces], np.int64), R.CrfWeights.preset().quantized(), 3)
    if bigrams:
        m.bigrams = {(r.choice([L.BOS_ID, *range(len(pieces))]), r.randrange(len(pieces))): r.randrange(-900, 300) for _ in range(40)}
    texts = ["".join(r.choice("ab1") for _ in range(r.randrange(1, 12))) for _ in range(120)]
    seeds = np.array([r.randrange(2**32) for _ in texts])
    lat = L.Lattice(texts, m.table, 3)
    bounds, score = L.drawn_paths(lat, m, 2.0, seeds)
    for x, s, b, v in zip(texts, seeds.tolist(), bounds, score):
        assert b.tolist() == plain_draw(m, x, 2.0, s)
        assert {tuple(np.cumsum([0, *cut]).tolist()): q for q, cut in path_scores(m, x)}[tuple(b.tolist())] == v


@pytest.fixture
def small_model():
    return L.Model(["a", "ab", "あ", "漢字"], np.array([-1, -2, -3, -400]), R.CrfWeights.preset().quantized(), 3, bigrams={(0, 1): -5}, flags=1, cc_mode="ranges", cc_ranges=(ClassRange(0x3040, 0x30FF, 4), ClassRange(0x4E00, 0x9FFF, 200)))


def test_binary_file(small_model):
    data = model_store.to_bytes(small_model)
    again = model_store.from_bytes(data)
    for f in ("pieces", "crf", "bigrams", "max_len", *model_store.SCALARS):
        assert getattr(again, f) == getattr(small_model, f)
    assert again.logp_q.tolist() == small_model.logp_q.tolist() and (again.cc_mode, again.cc_fallback, again.cc_ranges, again.flags) == ("ranges", "utf8len", small_model.cc_ranges, 1 | 1 << 10)
    data = model_store.to_bytes(replace(small_model, cc_ranges=()))
    old = data[:4] + b"v1\0\0" + (1).to_bytes(4, "little") + data[12:52] + data[64:]
    assert model_store.from_bytes(old).pieces == small_model.pieces and model_store.from_bytes(old).cc_mode == "utf8len"
    for broken, code in ((data[:20], -11), (b"x" * 100, -12), (data[:8] + b"\7" + data[9:], -13), (data[:-1], -19)):
        with pytest.raises(model_store.ModelFileError) as e:
            model_store.from_bytes(broken)
        assert e.value.code == code
    assert "model_bos_to1 = 128" in model_store.c_header(small_model)


def test_parquet_model(spark, small_model, tmp_path):
    model_store.save(small_model, spark, str(tmp_path))
    again = model_store.load(spark, str(tmp_path))
    assert (again.flags, again.cc_mode, again.cc_fallback, again.cc_ranges) == (small_model.flags, small_model.cc_mode, small_model.cc_fallback, small_model.cc_ranges)
    assert (again.pieces, again.crf, again.bigrams, again.lambda0) == (small_model.pieces, small_model.crf, small_model.bigrams, small_model.lambda0)
