"""Every operator on awkward tables, and against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import ctph, induced, linededup, lmscore, matroska, mixing, packing, quality, repeats, simhash, suffixes, tokencount
from lexweave.llm.core import string_bytes, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["code", "keep", "copies", "group_id", "quality", "toxicity", "epoch", "block", "place", "bin", "shard", "line_no", "hash", "print", "doc", "doc_of", "hash_of", "gone_lines", "emptied", "mix_source", "piece", "size", "a.b", "odd `name`"]
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(3000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = "\n".join(prose(60) for _ in range(3000))  # over a megabyte
BASE = prose(120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "b", 1),
    (3, NEAR, "en", "a", None),
    (3, NEAR, "en", "a", None),  # a row repeated in full
    (4, None, None, None, None),
    (5, "", "en", None, 0),
    (None, prose(80), "en", "a", 3),
    (None, None, None, None, None),
    (6, LONG, "de", "c", 5),
    (7, " \n\t\n", "de", "c", 5),
    (8, "x " * 4000, "de", "c", 5),
    (9, prose(90) + "\n" + BASE + "\n" + prose(40), "fr", "b", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        d = d.withColumn(c, F.lit(c))
    return d.persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("stage", [quality.keep_good, linededup.without_duplicates, simhash.near_dedup, mixing.mixed])
def test_stages_keep_the_columns(spark, docs, none, labels_dir, stage):
    out = stage(spark, docs, labels_dir)
    assert out.columns == docs.columns
    assert out.count() <= 4 * len(ROWS)
    assert {(r["code"], r["odd `name`"]) for r in out.collect()} <= {("code", "odd `name`")}
    assert stage(spark, none, labels_dir).columns == docs.columns
    assert stage(spark, none, labels_dir).count() == 0


def test_pack_awkward(docs, none):
    got = packing.pack(docs, 1000, 10).collect()
    assert packing.pack(none).count() == 0
    whole = {}
    for r in got:
        whole[r.doc_id, r.copy, r.piece] = whole.get((r.doc_id, r.copy, r.piece), 0) + r.size
    assert sum(r.size for r in got) == sum(len(t.encode()) + 1 for _, t, *_ in ROWS if t is not None)
    assert max(r.copy for r in got) == 2 and {r.doc_id for r in got if r.copy == 2} == {3}
    fill = {}
    for r in sorted(got, key=lambda r: r.at):
        assert r.at == fill.get((r.shard, r.bin), 0)
        fill[r.shard, r.bin] = r.at + r.size
    assert max(fill.values()) <= 1000
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(docs.repartition(3), 1000, 10).collect()))


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        cap = int(rng.integers(1, 50))
        sizes = np.sort(rng.integers(1, cap + 1, rng.integers(0, 80)))[::-1].copy()
        bins, at = packing.best_fit(sizes, cap)
        left = []
        for s, b, a in zip(sizes, bins, at):
            fits = [x for x in left if x >= s]
            if fits:
                assert left[b] == min(fits) and a == cap - left[b]
                left[b] -= s
            else:
                assert b == len(left) and a == 0
                left.append(cap - s)


def test_simhash_groups(docs, none):
    got = {(r.doc_id, r.text_hash): r for r in simhash.groups(docs).collect()}
    of = {d: (r.group_id, r.keep) for (d, _), r in got.items() if d}
    assert of[1] == (1, True) and of[2] == (1, False) and of[3] == (1, False)
    assert of[4] == (4, True) and of[5] == (5, True) and of[6] == (6, True)
    assert {d: r.links for (d, _), r in got.items() if d in (1, 2, 3, 4)} == {1: 3, 2: 3, 3: 3, 4: 0}
    assert simhash.groups(none).count() == 0


def test_simhash_recall(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(120):
        base = [rng.choice(VOCABULARY) for _ in range(150)]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((k, " ".join(w)))
            k += 1
    code, _ = simhash.fingerprint_rows(*string_bytes(pa.array([t for _, t in rows])))
    two = simhash.two_words(code)
    label = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.popcount((two[i] ^ two[j])[None])[0] <= simhash.RADIUS]
    for i, j in pairs:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hit = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 50 and hit >= 0.95 * len(pairs)
    assert all(label[a] == label[got[a]] for a in got)


def test_forest_prunes_real_fingerprints():
    import pyarrow.parquet as pq

    code, some = simhash.fingerprint_rows(*string_bytes(pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"]))
    two = np.unique(simhash.two_words(code[some]), axis=0)[::3]
    rank = simhash.gray_rank(two)
    two = two[np.lexsort((rank[:, 1], rank[:, 0]))]
    forest = simhash.Forest(two, np.zeros(len(two), np.int64))
    found = [forest.pairs(np.arange(lo, min(lo + 500, len(two))), simhash.RADIUS) for lo in range(0, len(two), 500)]
    assert sum(len(a) for a, _ in found) > 50 and forest.visits <= 0.05 * len(two) * (len(two) - 1) / 2


def test_sizing_keeps_the_recall():
    for n in (10, 10**5, 10**7, 10**10):
        prefix, tables = simhash.sizing(n, simhash.RADIUS)
        assert n / 2**prefix <= 32 or prefix == 40
        assert 1 - (1 - np.prod(1 - simhash.RADIUS / (128 - np.arange(prefix)))) ** tables >= simhash.RECALL


def test_components_of_a_hub_and_a_chain(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    chain = spark.range(200_000, 200_060).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(star.unionByName(chain)).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {r.root: r.n for r in got} == {0: 100_000, 200_000: 60}


def _moved(code, count, rng):
    bits = np.unpackbits(code, axis=1)
    for row, at in zip(bits, [rng.choice(128, count, replace=False) for _ in code]):
        row[at] ^= 1
    return np.packbits(bits, axis=1)


def test_simhash_leaves_out_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (400, 16), dtype=np.uint8)
    code = np.concatenate([base, _moved(base, simhash.RADIUS, rng)])
    prints = spark.createDataFrame([(k, k, bytes(c)) for k, c in enumerate(code)], "doc_id bigint, text_hash bigint, code binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: prints)
    got = {r.doc_id: r.group_id for r in simhash.groups(None).collect()}
    assert [k for k in range(400) if got[k + 400] != got[k]] == []
    assert len(set(got.values())) == 400


@pytest.mark.parametrize("block, slice_", [(1 << 20, 1 << 14), (300, 50)])
def test_simhash_missed_is_exact_in_blocks_and_slices(spark, block, slice_):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    code = np.concatenate([base, *(_moved(base, k, rng) for k in (2, 11, 22, 23))])
    two = simhash.two_words(code)
    want = {frozenset((bytes(code[i]), bytes(code[j]))) for i in range(len(two)) for j in np.flatnonzero(simhash.popcount(two[i] ^ two) <= 22) if i != j}
    rows = spark.createDataFrame([(bytes(c), bytes(c)) for c in code], "code binary, root binary")
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.missed(rows, len(code), 22, block, slice_).collect()}
    assert got == want
    # links within a component aren't given, the others are
    half = spark.createDataFrame([(bytes(c), bytes(code[k % 300]) if k < 900 else bytes(c)) for k, c in enumerate(code)], "code binary, root binary")
    root = {bytes(c): bytes(code[k % 300]) if k < 900 else bytes(c) for k, c in enumerate(code)}
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.missed(half, len(code), 22, block, slice_).collect()}
    assert got == {p for p in (frozenset(root[c] for c in pair) for pair in want) if len(p) == 2}


def test_simhash_across_a_dense_ball():
    rng = np.random.default_rng(7)
    ball = np.repeat(rng.integers(0, 256, (1, 16), dtype=np.uint8), 600, axis=0)
    two = simhash.two_words(np.unique(_moved(ball, 12, rng), axis=0))
    root = np.repeat(two[:1], len(two), axis=0)
    root[-5:] = two[-5:]  # five that the rest isn't yet linked to
    a, b = simhash.across(two, root, two, root, simhash.RADIUS, np.arange(len(two)))
    want = {(i, j) for i in range(len(two)) for j in range(i + 1, len(two)) if simhash.popcount((two[i] ^ two[j])[None])[0] <= simhash.RADIUS and (root[i] != root[j]).any()}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want and want


def test_near_dedup_keeps_one_and_the_same_of_rows_equal_in_id_and_text(spark):
    rows = [(1, BASE, x) for x in "bcad"] + [(2, prose(50), "z")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    kept = {tuple(sorted(r.tag for r in simhash.near_dedup(spark, x, "").collect())) for x in (d, d.orderBy("tag"), d.orderBy(F.desc("tag")).repartition(3))}
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_forest_finds_all_pairs_of_a_part():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (20, 16), dtype=np.uint8)
    code = base[rng.integers(0, 20, 300)]
    code = np.unique(code ^ (rng.random((300, 16, 8)) < 0.03).astype(np.uint8) @ (1 << np.arange(8, dtype=np.uint8)), axis=0)
    two = simhash.two_words(code)
    rank = simhash.gray_rank(two)
    assert len({tuple(r) for r in rank.tolist()}) == len(rank)
    back = [((int(h) << 64 | int(l)) ^ (int(h) << 64 | int(l)) >> 1) for h, l in rank]
    assert back == [int(h) << 64 | int(l) for h, l in two]
    order = np.lexsort((rank[:, 1], rank[:, 0]))
    two = two[order]
    a, b = simhash.Forest(two, np.zeros(len(two), np.int64)).pairs(np.arange(len(two)), 20)
    want = {(i, j) for i in range(len(two)) for j in range(i + 1, len(two)) if simhash.popcount((two[i] ^ two[j])[None])[0] <= 20}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def joined_bytes(rows):
    return np.frombuffer(b"".join(rows), np.uint8), np.r_[0, np.cumsum([len(r) for r in rows])]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_banded_distance(most):
    rng = random.Random(most)
    left, right = [], []
    for _ in range(400):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40)))
        b = bytearray(a)
        for _ in range(rng.randrange(0, most + 3)):
            k, p = rng.randrange(3), rng.randrange(len(b) + 1)
            if k == 0:
                b.insert(p, rng.choice(b"abc"))
            elif b:
                b[min(p, len(b) - 1)] = rng.choice(b"abc")
        left.append(a)
        right.append(bytes(b))
    got = linededup.edit_distances(*joined_bytes(left), *joined_bytes(right), most)
    assert got.tolist() == [min(edits(a, b), most + 1) for a, b in zip(left, right)]


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(11)
    pool = [prose(8, rng) for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            x = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                p = rng.randrange(len(x))
                x[p : p + rng.randrange(2)] = rng.choice(["q", "é", ""])
            lines.append("".join(x))
        rows.append((d, "\n".join([*lines, "short"])))
    order = [(d, n, x.encode()) for d, t in rows for n, x in enumerate(t.split("\n")) if x]
    first, want = {}, {}
    for d, n, x in order:
        if x in first:
            want[d, n] = (*first[x], 0)
        else:
            near = [(at, k) for y, at in first.items() if min(len(x), len(y)) >= linededup.LEAST and abs(len(x) - len(y)) <= 2 and (k := edits(x, y)) <= 2]
            if near:
                (a, b), k = min(near)
                want[d, n] = (a, b, k)
            first[x] = (d, n)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no, r.edits) for r in linededup.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and any(k for *_, k in want.values())


def test_line_dedup_of_short_lines(spark):
    import duckdb

    from lexweave.llm import queries

    long = "x" * 40
    rows = [(1, "All rights reserved.\n\na\n" + long), (2, "All rights reserved.\n\nAll rights reserve.\na\n" + long + "y"), (3, "a\n" + long[:31]), (4, long[:31] + "\n" + long[:30])]
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no, r.edits) for r in linededup.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(2, 0): (1, 0, 0), (2, 3): (1, 2, 0), (2, 4): (1, 3, 1), (3, 0): (1, 2, 0), (4, 0): (3, 1, 0)}
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    df = queries.QUERIES["op9_line_dedup"](spark, at)
    found = sorted(con.execute(queries.ORACLE_SQL["op9_line_dedup"]).fetchall())
    assert found == sorted(map(tuple, df.select("doc_id", "line_no", "kept_doc_id", "kept_line_no", "edits").collect()))


def test_line_dedup_of_one_id_with_different_texts(spark):
    dup, own = "this line stands in two documents and is long", "this one stands nowhere else and must not be lost"
    rows = [("a", dup), ("b", f"x\n{dup}"), ("b", f"y\n{own}"), ("b", f"y\n{own}"), ("c", f"{own}!\nz")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    out = sorted(map(tuple, linededup.without_duplicates(spark, d, "").collect()))
    texts = [t for _, t in out]
    assert texts.count(f"y\n{own}") + texts.count("y") == 2 and sum(t.count(dup) for t in texts) == 1
    assert sum(own in t for t in texts) in (1, 2) and all({"x", "y", "z"} & set("\n".join(texts).split("\n")))
    got = linededup.duplicates(d).collect()
    assert {r.doc_id for r in got} | {r.kept_doc_id for r in got} <= {"a", "b", "c"}
    ids = spark.createDataFrame([(1, dup), (2, f"x\n{dup}"), (2, f"y\n{own}")], "doc_id int, text string")
    assert sorted(map(tuple, linededup.without_duplicates(spark, ids, "").collect())) == [(1, dup), (2, "x"), (2, f"y\n{own}")]


@pytest.mark.parametrize("hashes", [0, 1_000_000])
def test_line_dedup_of_lines_that_share_a_segment(spark, monkeypatch, hashes):
    monkeypatch.setattr(linededup, "BROADCAST_HASHES", hashes)
    n = 10_000
    rows = [(k, "the same beginning of every line of all, but then %d" % (k * 7919 * 104729 % 10**9 + 10**9)) for k in range(n)]
    rows += [(n, rows[77][1] + "!"), (n + 1, rows[99][1].replace("same", "some"))]
    got = {r.doc_id: (r.kept_doc_id, r.edits) for r in linededup.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got[n][1] <= 1 and got[n + 1][1] <= 2
    of = dict(rows)
    for k, (kept, e) in list(got.items())[:300]:
        assert kept < k and edits(of[k].encode(), of[kept].encode()) == e


def test_parities_bound_the_edits():
    rng = random.Random(2)
    for _ in range(300):
        a = bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(4, 60)))
        b = bytearray(a)
        for _ in range(2):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(2)] = bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(2)))
        b = bytes(b)
        data = np.frombuffer(a + b"\n" + b, np.uint8)
        x, y = linededup.parities(data, np.array([0, len(a) + 1]), np.array([len(a), len(b)]))
        assert int(x ^ y).bit_count() <= 4 * edits(a, b)


def test_line_dedup_awkward(docs, none):
    got = {(r.doc_id, r.line_no) for r in linededup.duplicates(docs).collect()}
    assert (2, 0) in got and (9, 1) in got and (3, 0) not in got and (1, 0) not in got
    assert linededup.duplicates(none).count() == 0


def test_dropped_lines():
    assert linededup.drop_lines(["a\nb\nc", None, "a", "", "x"], [[1], [0], [0], None, []]) == ["a\nc", None, None, "", "x"]


def test_quality_learns(spark, tmp_path):
    rng = random.Random(2)
    rows, marks = [], []
    for d in range(1200):
        bad, toxic = rng.random() < 0.25, rng.random() < 0.25
        w = [rng.choice(VOCABULARY) for _ in range(rng.randrange(30, 120))]
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["slur", "insult", "curse"])
        rows.append((d, " ".join(w), "a"))
        marks.append((d, int(not bad), int(toxic)))
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").filter("doc_id < 800").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = {r.doc_id for r in quality.keep_good(spark, d, str(tmp_path)).collect()}
    held = [m for m in marks if m[0] >= 800]
    right = sum((m[0] in left) == (m[1] == 1 and m[2] == 0) for m in held)
    assert right >= 0.95 * len(held)


def test_quality_by_a_dense_solve(spark):
    at = "/root/testdata/sf0.01"
    docs_, labels_ = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs_, labels_)
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5))
    rows = docs_.join(labels_, "doc_id").withColumn("part", part).select("doc_id", "text", "quality", "toxic", "part").toPandas()
    x = quality.statistics(*string_bytes(pa.array(rows.text)), model.lexicon)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-2))
    z = quality.features(x, model.mean, model.scale)
    free = rows.part.isin(quality.RIDGE_PARTS).to_numpy()
    shrink = np.sqrt(np.r_[np.full(quality.FEATURES, quality.RIDGE), 1e-6])
    y = rows[["quality", "toxic"]].to_numpy(float)[free]
    want, *_ = np.linalg.lstsq(np.vstack([z[free], np.diag(shrink)]), np.vstack([y, np.zeros((len(shrink), 2))]), rcond=None)
    assert np.allclose(z @ model.coef, z @ want, atol=1e-5)
    held = (rows.part == quality.CALIBRATION_PART).to_numpy()
    for k, name in enumerate(("quality", "toxic")):
        score, label = (z @ model.coef)[held, k], rows[name].to_numpy(float)[held]
        got = np.interp(score, *model.steps[k])
        assert (np.diff(got[np.argsort(score)]) >= -1e-9).all() and abs(got.mean() - label.mean()) < 1e-6


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert np.allclose(np.interp([0, 1, 2, 3, 4, 9], x, y), [0, 0, 0.5, 0.5, 1, 1])


def test_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(0, 1, (40, quality.STATISTICS))
    z = quality.features(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    k = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - k).max() < 0.3 and np.abs(z @ z.T - k).mean() < 0.06


def test_mixing_plan():
    tokens = np.array([1000, 100, 50, 10])
    a = mixing.exponent_for(tokens)
    share = tokens / tokens.sum()
    r = mixing.repeats(share, a)
    assert r.min() == 1 and r.max() <= mixing.REPEATS + 1e-6
    assert mixing.entropy(mixing.weights_at(share, a)) >= 0.95 * np.log(4) - 1e-6 or r.max() > mixing.REPEATS - 1e-3
    assert mixing.exponent_for(np.array([5])) == 1.0 and mixing.exponent_for(np.array([5, 5])) == 1.0


@pytest.mark.parametrize("block", [500, 4000, 1 << 26])
def test_mixing_by_brute_force(spark, block):
    rng = random.Random(4)
    rows = [(d, "x" * rng.randrange(0, 90), "big" if d % 3 else rng.choice(["s", "t", None])) for d in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=block).collect()
    size = {d: len(t) + 1 for d, t, _ in rows}
    of = {d: s for d, _, s in rows}
    total = {}
    for d, s in of.items():
        total[s] = total.get(s, 0) + size[d]
    names = sorted(total, key=lambda s: (-total[s], s or ""))
    quota = dict(zip(names, mixing.plan(np.array([total[s] for s in names]))))
    for s in names:
        mine = [r for r in got if r.source == s]
        assert {r.doc_id for r in mine} == {d for d in of if of[d] == s}
        whole = quota[s] // total[s]
        last = sorted((r for r in mine if r.epoch == whole + 1), key=lambda r: (r.block_order, r.block, r.place, r.doc_id))
        places = [{r.doc_id: r.place for r in mine if r.epoch == e} for e in (1, 2)]
        assert not places[1] or any(places[0][d] != p for d, p in places[1].items())
        for e in range(1, whole + 1):
            assert sum(size[r.doc_id] for r in mine if r.epoch == e) == total[s]
        used = sum(size[r.doc_id] for r in last)
        assert quota[s] - whole * total[s] - 91 < used <= quota[s] - whole * total[s]


def test_mixing_empty(spark, none):
    assert mixing.mix_sources(none).count() == 0


def test_mixing_of_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame([(k, "x", str(k)) for k in range(3)], "doc_id bigint, text string, source string"))


def test_mixing_permutes_small_sources(spark):
    rows = [(d, "x" * 20, "big" if d % 2 else "small") for d in range(400)] + [(400 + d, "y" * 20, "big") for d in range(800)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    of = lambda e: [r.block for r in sorted((r for r in got if r.source == "small" and r.epoch == e), key=lambda r: (r.block_order, r.block))]
    assert len(set(of(1))) > 30 and of(1) != of(2) and sorted(of(1)) == sorted(of(2))


def byte_counts(texts):
    import base64

    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(tokencount.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [len(e.encode_ordinary(t)) for t in texts]


def test_token_counts(spark, docs, none):
    rng = random.Random(3)
    parts = ["a", "ll", "'", "'s", "'re", "don't", " ", "  ", "\n", "\t", "\r\n", "12", "٣", "é", "日本", "😀", "!", "...", "' s", " ", "aaaaaaa", "\x1c", "²", "́", "'ve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    assert tokencount.Counter(tokencount.RANKS).count(*string_bytes(pa.array(texts))).tolist() == byte_counts(texts)
    got = [(r.doc_id, r.tokens) for r in tokencount.token_counts(docs).collect()]
    want = [(d, None if t is None else byte_counts([t])[0]) for d, t, *_ in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokencount.token_counts(none).count() == 0


@pytest.mark.parametrize("sort", [suffixes.suffix_array, lambda x: induced.suffix_array(x, None, 3, 5), induced.suffix_array])
def test_suffix_arrays(sort):
    rng = random.Random(0)
    for _ in range(300):
        x = np.array([rng.randrange(rng.choice([1, 2, 5, 100])) for _ in range(rng.randrange(0, 60))], np.int64)
        assert sort(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_common_prefixes():
    rng = random.Random(1)
    for _ in range(400):
        n, k = rng.randrange(0, 60), rng.choice([1, 2, 5, 100])
        x = np.array([rng.randrange(k) for _ in range(n)], np.int64)
        if n > 8 and rng.random() < 0.3:
            x[n // 2 : n // 2 + n // 4] = x[: n // 4]
        most = rng.choice([1, 2, 5, 50, 254])
        sa, lcp = induced.suffix_array_lcp(x, most, None, rng.choice([1, 3, 10, 1000]), 1000)
        want = sorted(range(n), key=lambda i: x[i:].tolist())
        shared = [0] * n
        for j in range(1, n):
            a, b = want[j - 1], want[j]
            while shared[j] < most and max(a, b) + shared[j] < n and x[a + shared[j]] == x[b + shared[j]]:
                shared[j] += 1
        assert sa.tolist() == want and lcp.tolist() == shared


def test_induced_with_files(tmp_path):
    x = np.random.default_rng(0).integers(0, 3, 5000)
    assert (induced.suffix_array(x, f"file://{tmp_path}", 100, 50) == suffixes.suffix_array(x)).all()
    assert not list(tmp_path.iterdir())


def test_repeats_by_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(rng.randrange(50, 90), rng) for _ in range(5)]
    rows = [(d, " ".join(x for _ in range(3) for x in (prose(rng.randrange(0, 60), rng), rng.choice([*passages, "", "", ""])))) for d in range(40)]
    rows += [(40, "w " * 300), (41, "w " * 120), (42, rows[0][1]), (43, rows[0][1])]
    w = words(*string_bytes(pa.array([t for _, t in rows])))
    seen = {}
    for d in range(len(rows)):
        h = w.hash[w.rows[d] : w.rows[d + 1]].tolist()
        for p in range(len(h) - 49):
            seen.setdefault(tuple(h[p : p + 50]), []).append((d, p))
    want = {(d, p): min(v)[0] for v in seen.values() for d, p in v if d > min(v)[0]}
    got = {}
    for r in repeats.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        for p in range(r.start_word, r.start_word + r.words - 49):
            assert (r.doc_id, p) not in got
            got[r.doc_id, p] = r.first_doc_id
    assert got == want and want


@pytest.mark.parametrize("shard", [500, 10**6])
def test_repeats_of_ids_of_any_type(spark, shard):
    passage = prose(60)
    rows = [("a", passage + " " + prose(20)), ("b", prose(10) + " " + passage), ("c", prose(70)), ("d", None), (None, passage)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    (r,) = repeats.repeated(d, shard=shard).collect()
    assert {r.doc_id, r.first_doc_id} == {"a", "b"} and r.words == 60
    numbers = d.withColumn("doc_id", F.ascii("doc_id").cast("int"))
    (r,) = repeats.repeated(numbers, shard=shard).collect()
    assert (r.doc_id, r.start_word, r.words, r.first_doc_id, r.first_start_word) == (98, 10, 60, 97, 0)


def test_repeats_awkward(docs, none):
    got = {(r.doc_id, r.first_doc_id) for r in repeats.repeated(docs).collect()}
    assert {(2, 1), (3, 1), (9, 1)} <= got and not any(a == b for a, b in got)
    assert repeats.repeated(none).count() == 0


def lm_brute(query, texts):
    """log probability of a list of words, by counting in all texts."""
    docs_ = [t.split() for t in texts]
    n, v = sum(map(len, docs_)), len({w for d in docs_ for w in d})

    def count(x, open_=False):
        return sum(d[i : i + len(x)] == x and (not open_ or i + len(x) < len(d)) for d in docs_ for i in range(len(d) - len(x) + 1))

    out, contexts = 0.0, []
    for i, w in enumerate(query):
        p, k = (count([w]) + 1) / (n + v + 1), 0
        while k < i and (c := count(query[i - k - 1 : i], True)):
            k += 1
            p = (count(query[i - k : i + 1]) + lmscore.STRENGTH * p) / (c + lmscore.STRENGTH)
        out += np.log(p)
        contexts.append(k)
    return out, contexts


@pytest.mark.parametrize("shard", [20, 1000])
def test_lm_by_brute_force(spark, shard):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 20))) for _ in range(25)] + [None, ""]
    queries = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 12)))) for k in range(8)] + [(90, texts[0]), (91, None)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for block in (10, 10_000):
        got = {r.item_id: r for r in lmscore.lm_scores(spark.createDataFrame(queries, "item_id bigint, text string"), corpus, "item_id", False, block, shard).collect()}
        for k, t in queries:
            if not t:
                assert got[k].words == 0 and got[k].log_probability is None
                continue
            want, contexts = lm_brute(t.split(), [x for x in texts if x])
            assert abs(got[k].log_probability - want) < 1e-9
            assert got[k].longest_context == max(contexts) and abs(got[k].mean_context - np.mean(contexts)) < 1e-9


@pytest.mark.parametrize("shard", [40, 100_000])
def test_lm_of_documents_against_the_others_by_brute_force(spark, docs, none, shard):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 30))) for _ in range(30)]
    texts += [texts[3], texts[4] + " a b", "q r s " + texts[4], prose(70, rng), "a " * 20, "a " * 17, None, ""]
    texts.append(texts[33] + " z " + texts[33])
    texts.append("zz " + texts[33])
    texts += ["k l " * 40, "k l " * 40 + "k", prose(9, rng) + " k l k l k"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in lmscore.lm_scores(d, d, "doc_id", True, 60, shard).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        if not t:
            assert got[k].words == 0 and got[k].log_probability is None
            continue
        want, contexts = lm_brute(t.split(), [x for j, x in enumerate(texts) if x and j != k])
        assert abs(got[k].log_probability - want) < 1e-9
        assert got[k].longest_context == max(contexts) and abs(got[k].mean_context - np.mean(contexts)) < 1e-9
    assert lmscore.lm_scores(none, none, "doc_id", True).count() == 0


def test_lm_records_of_a_long_copy_are_few():
    rng = random.Random(3)
    h = np.array([rng.getrandbits(63) for _ in range(2000)], np.uint64)
    q = lmscore.Queries(h, np.array([0, len(h)]))
    dense = np.zeros((len(h), lmscore.DENSE, 2), np.int64)
    s = lmscore.Shard.of(np.r_[h, h, h[:100]], np.array([0, 2000, 4000, 4100]))
    deep = lmscore.shard_counts(q, s, dense)
    assert len(deep) <= 4 * len(h) and (dense[50, 0] == [3, 3]).all()
    r = lmscore.summed(dense, [deep])
    last = r[r["place"] == 1999]
    assert last["depth"].tolist() == [1, 2001] and last["count"].tolist() == [2, 0]


def test_lm_searches_begin_where_places_match_already(monkeypatch):
    rng = random.Random(4)
    texts = [[rng.getrandbits(63) for _ in range(400)] for _ in range(50)]
    query = [w for t in texts for w in [*t[100:106], rng.getrandbits(63)]]  # a run of six words of each
    q = lmscore.Queries(np.array(query, np.uint64), np.array([0, len(query)]))
    s = lmscore.Shard.of(np.array(sum(texts, []), np.uint64), np.arange(51) * 400)
    dense, asked, hash_ = np.zeros((len(query), lmscore.DENSE, 2), np.int64), [], lmscore.Runs.hash
    monkeypatch.setattr(lmscore.Runs, "hash", lambda self, start, size: asked.append(len(start)) or hash_(self, start, size))
    deep = lmscore.shard_counts(q, s, dense)
    assert len(deep) == 2 * 100 and (dense.reshape(50, 7, -1)[:, 5] == 1).all()
    assert sum(asked) <= 8 * 100  # places that match more than DENSE words


def test_narrow_by_enumeration():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, 300)
    sa = suffixes.suffix_array(x)
    lo, hi = np.searchsorted(x[sa], np.arange(4)), np.searchsorted(x[sa], np.arange(4), side="right")
    for token in range(-1, 6):
        a, b = suffixes.narrow(x, sa, np.r_[lo, 5], np.r_[hi, 5], 1, np.full(5, token))
        second = np.append(x, -2)[sa + 1]
        assert (b - a)[:4].tolist() == [int((second[i:j] == token).sum()) for i, j in zip(lo, hi)] and a[4] == b[4]
        assert all((second[i:j] == token).all() for i, j in zip(a, b))


def test_lm_rows_repeated_in_full_count_for_each_other(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x a b c d e y"), (3, "q")]
    for shard in (3, 1000):
        d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
        got = {r.doc_id: r for r in lmscore.lm_scores(d, d, "doc_id", True, 1000, shard).collect()}
        for k, n in ((1, 3), (2, 1), (3, 1)):
            t = next(t for i, t in rows if i == k)
            rest = [x for _, x in rows]
            rest.remove(t)
            want, contexts = lm_brute(t.split(), rest)
            assert abs(got[k].log_probability - n * want) < 1e-9 and got[k].longest_context == max(contexts)


def test_lm_shards_hold_only_what_long_contexts_may_lie_in(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = [" ".join(word() for _ in range(300)) for _ in range(40)]
    passage = texts[3].split()[100:120]
    query = " ".join([word(), *passage, word(), *texts[5].split()[296:], word()])
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    folder = Path(urlparse(lmscore.shared_dir(spark)).path)
    before = set(folder.glob("suffixes-*"))
    (r,) = lmscore.lm_scores(spark.createDataFrame([(1, query)], "item_id bigint, text string"), corpus, "item_id").collect()
    want, contexts = lm_brute(query.split(), texts)
    assert abs(r.log_probability - want) < 1e-9 and r.longest_context == max(contexts) == 20 and abs(r.mean_context - np.mean(contexts)) < 1e-9
    held = [lmscore.Shard.read(f.read_bytes()) for f in set(folder.glob("suffixes-*")) - before]
    assert 0 < sum(len(s.back) - s.texts for s in held) < 600  # of 12,000 words; the filter lets 1 in 200 through


def test_lm_filter_passes_all_that_is_asked_for_and_little_else(tmp_path):
    rng = np.random.default_rng(9)
    h, other = rng.integers(0, 2**63, (2, 20_000), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    pieces = []
    for bucket in range(7):
        piece = lmscore.Filter.piece(h[h % np.uint64(7) == bucket])
        (tmp_path / f"p{bucket}").write_bytes(piece.tobytes())
        pieces.append((bucket, str(tmp_path / f"p{bucket}"), 8 * len(piece)))
    for most in (1, 10**9):  # a piece at a time, all at once
        f = lmscore.Filter(lmscore.fs.LocalFileSystem(), pieces, 7, most)
        assert f.has(h).all() and f.has(other).mean() < 0.01
    assert not lmscore.Filter(lmscore.fs.LocalFileSystem(), [], 7).has(h).any()


def test_lm_query_set_is_every_twentieth_document(spark):
    got = {r.doc_id for r in lmscore.op3_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.doc_id % 20 == 0}


def test_lm_sums_to_one(spark):
    texts = ["a b a c", "b a"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    queries = [(k, f"b {w}") for k, w in enumerate("abcz")] + [(9, "b")]
    got = {r.item_id: r.log_probability for r in lmscore.lm_scores(spark.createDataFrame(queries, "item_id bigint, text string"), corpus, "item_id").collect()}
    assert abs(sum(np.exp(got[k] - got[9]) for k in range(4)) - 1) < 1e-9


def test_lm_awkward(spark, docs, none):
    assert lmscore.lm_scores(docs, none, "doc_id").filter("words > 0").agg(F.max("perplexity")).first()[0] == 1.0
    assert lmscore.lm_scores(none, docs, "doc_id").count() == 0
    got = {r.doc_id: r for r in lmscore.lm_scores(docs, docs, "doc_id", own=True).collect() if r.doc_id}
    assert got[2].longest_context == 119 and got[4].words == 0 and got[6].words > 100_000


def test_matroska_round_trip():
    rng = random.Random(2)
    for n in [0, 1, 5, 399, 400, 401, 5000, 70000]:
        x = bytes(rng.randrange(256) for _ in range(n))
        f = matroska.mux(x)
        rows = matroska.parse(f)
        assert b"".join(f[r[6] : r[6] + r[7]] for r in rows) == x
        assert all(r[-1] is None for r in rows)
    assert {r[4] for r in rows} == {"none", "xiph", "fixed", "ebml"} and any(r[9] for r in rows)
    times = {}
    for r in rows:
        times.setdefault(r[1], []).append(r[2])
    assert all(t == sorted(t) for t in times.values())


def test_matroska_by_hand():
    e = matroska.element
    fixed = b"\x81\x00\x05\x84" + b"\x01" + b"xxyy"
    laced = b"\x81\xff\xfe\x02\x02" + b"\xff\x01" + b"\x00" + b"z" * 256 + b"y" * 4
    cluster = e(matroska.CLUSTER, matroska.integer(matroska.TIMESTAMP, 100) + e(matroska.SIMPLE_BLOCK, fixed) + e(matroska.SIMPLE_BLOCK, laced))
    data = matroska.HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    rows = matroska.parse(data)
    assert [(r[1], r[2], r[3], r[4], r[7]) for r in rows] == [(1, 105_000_000, True, "fixed", 2), (1, 105_000_000, True, "fixed", 2), (1, 98_000_000, False, "xiph", 256), (1, 98_000_000, False, "xiph", 0), (1, 98_000_000, False, "xiph", 4)]
    assert data[rows[4][6] : rows[4][6] + 4] == b"yyyy"


def plain_tree(d, at, end):
    """Every element as (id, first byte, content begin, content end, children), by trial: a slow reader of its own."""
    masters = {0x18538067, 0x1F43B675, 0x1549A966, 0x1654AE6B, 0xAE, 0xA0, 0x1C53BB6B, 0xBB, 0xB7, 0x1A45DFA3}
    out = []
    while at < end:
        first, n = at, 1
        while not d[at] >> 8 - n & 1:
            n += 1
        name = int("".join(f"{x:08b}" for x in d[at : at + n]), 2)
        at += n
        n = 1
        while not d[at] >> 8 - n & 1:
            n += 1
        bits = "".join(f"{x:08b}" for x in d[at : at + n])[n:]
        at += n
        stop = end if set(bits) == {"1"} else at + int(bits, 2)
        if set(bits) == {"1"} and name == 0x1F43B675:  # up to the next cluster or cues
            stop = min([k for k in (d.find(b"\x1f\x43\xb6\x75", at, end), d.find(b"\x1c\x53\xbb\x6b", at, end)) if k >= 0] or [end])
        out.append((name, first, at, stop, plain_tree(d, at, stop) if name in masters else []))
        at = stop
    return out


def plain_packets(d):
    whole = lambda a, b: int(d[a:b].hex() or "0", 16)
    rows = []
    for name, _, body, _, kids in plain_tree(d, 0, len(d)):
        if name != 0x18538067:
            continue
        get = lambda rows_, *names: [x for x in rows_ if x[0] in names]
        scale = next((whole(x[2], x[3]) for i in get(kids, 0x1549A966) for x in get(i[4], 0x2AD7B1)), 10**6)
        last = {}
        for t in get(kids, 0x1654AE6B):
            for e in get(t[4], 0xAE):
                last[whole(*get(e[4], 0xD7)[0][2:4])] = next((whole(x[2], x[3]) for x in get(e[4], 0x23E383)), 0)
        cues = {(whole(*get(p[4], 0xF7)[0][2:4]), whole(*get(c[4], 0xB3)[0][2:4]), body + whole(*get(p[4], 0xF1)[0][2:4])) for q in get(kids, 0x1C53BB6B) for c in get(q[4], 0xBB) for p in get(c[4], 0xB7)}
        for c in get(kids, 0x1F43B675):
            base = whole(*get(c[4], 0xE7)[0][2:4])
            for e in get(c[4], 0xA3, 0xA0):
                b = e if e[0] == 0xA3 else get(e[4], 0xA1)[0]
                at, end = b[2], b[3]
                track, time, flags = d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 3], "big", signed=True), d[at + 3]
                at, kind, sizes = at + 4, flags >> 1 & 3, []
                if kind:
                    n, at = d[at] + 1, at + 1
                    if kind == 2:
                        sizes = [(end - at) // n] * n
                    for k in range(n - 1) if kind in (1, 3) else ():
                        if kind == 1:
                            full = next(j for j in range(at, end) if d[j] != 255)
                            sizes.append((full - at) * 255 + d[full])
                            at = full + 1
                        else:
                            m = 8 - d[at].bit_length() + 1
                            v = whole(at, at + m) - (1 << 7 * m)
                            sizes.append(v if k == 0 else sizes[-1] + v - ((1 << 7 * m - 1) - 1))
                            at += m
                    if kind in (1, 3):
                        sizes.append(end - at - sum(sizes))
                else:
                    sizes = [end - at]
                length = get(e[4], 0x9B)
                step = last.get(track) or (whole(*length[0][2:4]) * scale // len(sizes) if length else 0)
                key = not get(e[4], 0xFB) if e[0] == 0xA0 else bool(flags & 0x80)
                for k, n in enumerate(sizes):
                    rows.append((track, (base + time) * scale + k * step, key, ("none", "xiph", "fixed", "ebml")[kind], k, at, n, c[1], k == 0 and (track, base + time, c[1]) in cues))
                    at += n
    return rows


def test_matroska_by_a_slow_reader():
    rng = random.Random(6)
    for n in (0, 1, 399, 5000, 60_000):
        f = matroska.mux(bytes(rng.randrange(256) if n < 5000 else rng.randrange(16) for _ in range(n)))
        assert [r[1:10] for r in matroska.parse(f)] == plain_packets(f)


def test_matroska_segments_of_their_own():
    e, i = matroska.element, matroska.integer
    block = lambda track, time: e(matroska.SIMPLE_BLOCK, bytes([0x80 | track]) + time.to_bytes(2, "big") + b"\x80xy")
    cluster = e(matroska.CLUSTER, i(matroska.TIMESTAMP, 10) + block(1, 1) + e(matroska.ENCRYPTED_BLOCK, b"\x81\x00\x02\x00z"))
    strip = e(matroska.ENCODINGS, e(matroska.ENCODING, e(matroska.COMPRESSION, i(matroska.ALGORITHM, 3) + e(matroska.SETTINGS, b"PRE"))))
    late = cluster + e(matroska.TRACKS, e(matroska.TRACK_ENTRY, i(matroska.TRACK_NUMBER, 1) + strip)) + e(matroska.INFO, matroska.with_crc(i(matroska.SCALE, 1000)))
    f = matroska.HEADER + e(matroska.SEGMENT, late, 8) + e(matroska.SEGMENT, cluster, 8)
    rows = matroska.parse(f)
    assert [(r[2], r[10], r[11]) for r in rows] == [(11_000, "strip", b"PRE"), (12_000, "encrypted", b"PRE"), (11_000_000, None, None), (12_000_000, "encrypted", None)]
    bad = f.replace(i(matroska.SCALE, 1000), i(matroska.SCALE, 1001))
    rows = matroska.parse(bad)
    assert rows[0][2] == 11_011 and [(r[6], r[-1]) for r in rows if r[-1]] == [(bad.index(bytes.fromhex("1549a966")), "crc")]
    limit = e(matroska.EBML, i(matroska.MAX_ID, 4) + i(matroska.MAX_SIZE, 4)) + f[len(matroska.HEADER) :]
    assert matroska.parse(limit)[-1][-1] == "size"


def test_matroska_broken(spark, docs, none):
    f = matroska.mux(prose(800).encode())
    for cut in range(0, len(f), 61):
        rows = matroska.parse(f[:cut])
        assert rows == [] or rows[-1][-1] in (None, "empty", "not ebml", "truncated", "size", "lacing", "crc")
    rng = random.Random(1)
    for _ in range(2000):
        g = bytearray(f)
        for _ in range(4):
            g[rng.randrange(len(g))] = rng.randrange(256)
        matroska.parse(bytes(g))
    assert matroska.parse(None)[0][-1] == "null" and matroska.parse(b"")[0][-1] == "empty" and matroska.parse(b"abcdef")[0][-1] == "not ebml"
    got = matroska.packets(matroska.muxed(docs)).groupBy("doc_id").agg(F.sum("size").alias("n")).collect()
    assert {r.doc_id: r.n for r in got if r.doc_id}[6] == len(LONG.encode())
    assert matroska.packets(matroska.muxed(none)).count() == 0


def test_myers():
    rng = random.Random(1)
    a, b = ([bytes(rng.randrange(4) for _ in range(rng.randrange(0, 65))) for _ in range(200)] for _ in range(2))
    assert ctph.myers(*joined_bytes(a), *joined_bytes(b)).tolist() == [edits(x, y) for x, y in zip(a, b)]


def test_trigger_levels():
    texts = [b"hello world this is a test " * 5, b"", b"abc"]
    want = []
    for x in texts:
        for i in range(len(x)):
            w = x[max(0, i - 6) : i + 1][::-1]
            s = 0
            for j, c in enumerate(w):
                s ^= c << 5 * j & 0xFFFFFFFF
            h = (sum(w) + sum((7 - j) * c for j, c in enumerate(w)) + s & 0xFFFFFFFF) + 1
            k = -1
            while h % (3 * 2 ** (k + 1)) == 0:
                k += 1
            want.append(k)
    assert ctph.trigger_levels(*joined_bytes(texts)).tolist() == want


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for d in range(90):
        t = prose(rng.choice([1, 40, 300, 600]), rng)
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            t = " ".join(w)
        rows.append((d, t))
    k, letters, offs = ctph.signatures(*string_bytes(pa.array([t for _, t in rows])))
    sig = [ctph.capped_runs(x, o) for x, o in zip(letters, offs)]
    of = lambda d, up: sig[up][0][sig[up][1][d] : sig[up][1][d + 1]].tobytes()
    score = lambda x, y: 100 * (max(len(x), len(y)) - edits(x, y)) // max(len(x), len(y), 1)
    grams = lambda x: {x[i : i + 7] for i in range(len(x) - 6)}
    want = {}
    for b in range(len(rows)):
        for a in range(b):
            if k[a] == k[b] and of(a, 0) == of(b, 0) and of(a, 1) == of(b, 1):
                want[b] = (a, 100)
                break
        else:
            for a in range(b):
                common = [(x, y) for x in (0, 1) for y in (0, 1) if k[a] + x == k[b] + y]
                if any(grams(of(a, x)) & grams(of(b, y)) for x, y in common):
                    best = max(score(of(a, x), of(b, y)) for x, y in common)
                    if best >= ctph.LEAST_SCORE:
                        want[b] = (a, best)
                        break
    got = {r.doc_id: (r.match_id, r.score) for r in ctph.matched(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.match_id is not None}
    assert got == want and any(s < 100 for _, s in want.values())


def test_fingerprints_give_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for d in range(80):
        t = prose(rng.choice([40, 300, 600]), rng)
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            t = " ".join(w)
        rows.append((d, t))
    k, letters, offs = ctph.signatures(*string_bytes(pa.array([t for _, t in rows])))
    sig = [ctph.capped_runs(x, o) for x, o in zip(letters, offs)]
    of = lambda d, up: sig[up][0][sig[up][1][d] : sig[up][1][d + 1]].tobytes()
    score = lambda x, y: 100 * (max(len(x), len(y)) - edits(x, y)) // max(len(x), len(y), 1)
    grams = lambda x: {x[i : i + ctph.GRAM] for i in range(len(x) - ctph.GRAM + 1)}
    want = {}
    for b in range(len(rows)):
        for a in range(b):
            common = [(x, y) for x in (0, 1) for y in (0, 1) if k[a] + x == k[b] + y]
            if k[a] == k[b] and of(a, 0) == of(b, 0) and of(a, 1) == of(b, 1):
                want[a, b] = 100
            elif any(grams(of(a, x)) & grams(of(b, y)) for x, y in common):
                best = max(score(of(a, x), of(b, y)) for x, y in common)
                if best >= ctph.LEAST_SCORE:
                    want[a, b] = best
    out = ctph.matched(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    members, got = {}, {}
    for r in out:
        members.setdefault(r.group_id, []).append(r.doc_id)
    for m in members.values():
        got |= {(a, b): 100 for a in m for b in m if a < b}
    for r in out:
        for x in r.matches or []:
            assert x.doc_id == min(members[x.group_id]) < r.doc_id == min(members[r.group_id])
            for a in members[x.group_id]:
                for b in members[r.group_id]:
                    assert (min(a, b), max(a, b)) not in got
                    got[min(a, b), max(a, b)] = x.score
    assert got == want and len(want) > 2 * len({b for _, b in want}) and any(len(m) > 1 for m in members.values())


def test_fingerprints_awkward(docs, none):
    got = {r.doc_id: r for r in ctph.matched(docs).collect() if r.doc_id}
    assert (got[2].match_id, got[2].score) == (1, 100) and got[4].signature is None and got[5].signature == "" and got[5].block_size == 3
    assert ctph.matched(none).count() == 0
