"""Segmentation of text columns with a joint model: best path, several best, and drawn ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import lattice as L
from lexweave.ship import map_arrow
from lexweave.sources.corpus import spread

MAX_NBEST = 64


def _tokens(text: str, bounds: np.ndarray) -> list[str]:
    b = bounds.tolist()
    return [text[x:y] for x, y in zip(b, b[1:])]


def _mapped(df: DataFrame, text: str, model: L.Model, add: str, work: Callable, most: int = L.BATCH, lattices: bool = False) -> DataFrame:
    """df with columns added that work(model, lattice, batch, rows) gives for the texts that are neither null nor empty: arrays in the lattice's order.

    With lattices, work also gives first for each of its values the number of its text in the lattice's order, and texts may have several rows or none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    at = df.columns.index(text)
    names = [*df.columns, *(x.strip().split(" ")[0] for x in add.split(";"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        types = [f.type for f in schema][len(kept) :]
        for b in batches:
            points, offs = L.arrow_points(b.column(at))
            size = np.diff(offs)
            some = np.flatnonzero(size)
            source: list[np.ndarray] = []
            cols: list[list[pa.Array]] = [[] for _ in types]
            for part in L.groups(size[some], most):
                rows = some[part]
                lat = L.Lattice(L.some_rows(points, offs, rows), m.table, m.max_len)
                got = work(m, lat, b, rows)
                source.append(rows[lat.order[got[0]] if lattices else lat.order])
                for c, x, kind in zip(cols, got[1:] if lattices else got, types):
                    c.append((x if isinstance(x, pa.Array) else pa.array(x)).cast(kind))
            if not lattices:
                rest = np.flatnonzero(size == 0)
                null = b.column(at).is_null().to_numpy(zero_copy_only=False)[rest]
                source.append(rest)
                for c, kind in zip(cols, types):
                    empty = [] if pa.types.is_list(kind) else "" if pa.types.is_string(kind) else 0
                    c.append(pa.array([None if x else empty for x in null.tolist()], kind))
            if not source:
                continue
            all_ = np.concatenate(source)
            order = np.argsort(all_, kind="stable")
            take = pa.array(order)
            kept_ = b.columns if not lattices else [c.take(pa.array(all_[order])) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*kept_, *(pa.concat_arrays(c).take(take) for c in cols)], names=names)

    ddl = ", ".join([*kept, *(x.strip() for x in add.split(";"))])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return map_arrow(spread(df), run, ddl)


def _words(sep: str | None) -> tuple[str, Callable]:
    """Columns of words, and what makes them of a lattice and boundaries: lists, or their number and one string with a character between them."""
    if sep is None:
        return "tokens array<string>", lambda lat, mark: (L.token_lists(lat, mark),)
    return "n_tokens bigint; joined string", lambda lat, mark: (L.word_counts(lat, mark), L.joined_words(lat, mark, sep))


def tokenize(df: DataFrame, model: L.Model, text: str = "line", sep: str | None = None) -> DataFrame:
    """df with tokens and the path's score in Q8.8. A null text has null tokens, an empty one none. With sep, n_tokens and the tokens joined by it stand in place of tokens."""
    add, words = _words(sep)

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        mark, score = L.best_marks(lat, m)
        return *words(lat, mark), score

    return _mapped(df, text, model, f"{add}; score bigint", work)


def _lm_path(m: L.Model, lat: L.Lattice) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Boundaries and scores by the unigram model, and where there is no path."""
    mark, score, ok = L.marked_path(lat, lat.lm_fixed(m.logp), 0, longest_wins=True)
    return mark, np.where(ok, score, 0) / L.FIXED, ~ok


def tokenize_lm(df: DataFrame, model: L.Model, text: str = "line", sep: str | None = None) -> DataFrame:
    """df with the tokens and log probability of the best path by the unigram model alone; null where no path of known pieces covers the text. sep is as in tokenize()."""
    add, words = _words(sep)

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        mark, logp, none = _lm_path(m, lat)
        cols = [x if isinstance(x, pa.Array) else pa.array(x) for x in (*words(lat, mark), logp)]
        return tuple(pa.compute.if_else(pa.array(~none), x, pa.scalar(None, x.type)) for x in cols) if none.any() else tuple(cols)

    return _mapped(df, text, model, f"{add}; logp double", work)


def lm_labels(df: DataFrame, model: L.Model, text: str = "line") -> DataFrame:
    """df with y: for each character 1 where a word of the unigram model's best path begins, else 0, as a string; only ones where there is no path."""

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        mark, _, none = _lm_path(m, lat)
        return (L.labels(lat, mark | none[lat.row]),)

    return _mapped(df, text, model, "y string", work)


def _checked(n: int) -> int:
    if n > MAX_NBEST:
        raise ValueError(f"n-best of {n}: {MAX_NBEST} at most")
    return max(1, n)


def tokenize_nbest(df: DataFrame, model: L.Model, n: int = 8, text: str = "line") -> DataFrame:
    """df with its n best segmentations as an array of (rank, score, tokens); 0 counts as 1."""
    n = _checked(n)

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        row, rank, score, tokens = _paths(lat, *L.best_n_marks(lat, m, n), L.token_lists)
        by = np.lexsort((rank, row))
        each = pa.StructArray.from_arrays([pa.array(rank.astype(np.int32)), pa.array(score), tokens], ["rank", "score", "tokens"]).take(pa.array(by))
        return (pa.ListArray.from_arrays(pa.array(np.searchsorted(row[by], np.arange(len(lat.base) + 1)), pa.int32()), each),)

    return _mapped(df, text, model, "nbest array<struct<rank:int,score:bigint,tokens:array<string>>>", work, L.batch_for(n))


def _paths(lat: L.Lattice, mark: np.ndarray, final: np.ndarray, there: np.ndarray, *made: Callable) -> tuple:
    """Sentence, rank, score and what is made of the boundaries of each path that there is."""
    path, row = np.nonzero(there)
    cols = []
    for f in made:
        parts = [(x if isinstance(x := f(lat, mark[k]), pa.Array) else pa.array(x)).take(pa.array(np.flatnonzero(there[k]))) for k in range(len(mark))]
        cols.append(pa.concat_arrays(parts))
    return row, path, final[path, row], *cols


def nbest_joined(df: DataFrame, model: L.Model, n: int, sep: str, text: str = "line") -> DataFrame:
    """A row for each of the n best segmentations of a text, with rank, score, n_tokens and the tokens joined; none for a text that is null or empty."""
    n = _checked(n)

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        return _paths(lat, *L.best_n_marks(lat, m, n), L.word_counts, lambda lat, mark: L.joined_words(lat, mark, sep))

    return _mapped(df, text, model, "rank int; score bigint; n_tokens bigint; joined string", work, L.batch_for(n), lattices=True)


def one_of_nbest(df: DataFrame, model: L.Model, n: int, sep: str, seed: str = "seed", text: str = "line") -> DataFrame:
    """As nbest_joined(), but of each text's n best only the one that pick_from_nbest() takes by the seeds of a column."""
    n, at = _checked(n), df.columns.index(seed)

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        state = L.xorshift32(_seeds(b, at, rows)).astype(np.int64)
        picked = np.empty(0, np.int64)

        def want(count: np.ndarray, order: np.ndarray) -> np.ndarray:
            nonlocal picked
            picked = state[order] % np.maximum(count, 1)
            return picked

        row, _, score, *cols = _paths(lat, *L.best_n_marks(lat, m, n, want), L.word_counts, lambda lat, mark: L.joined_words(lat, mark, sep))
        return row, picked[row], score, *cols

    return _mapped(df, text, model, "rank int; score bigint; n_tokens bigint; joined string", work, L.batch_for(n), lattices=True)


def emission_sums(df: DataFrame, model: L.Model, text: str = "line") -> DataFrame:
    """df with the sums of the CRF's emissions of both labels over the text, and the greatest and least sum of label 0 up to a place."""

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        e0, e1 = (m.emit[y][lat.class_codes(m)] for y in (0, 1))
        first = lat.offs[:-1]
        total = np.cumsum(e0)
        run = total - np.repeat(total[first] - e0[first], lat.size)
        return np.add.reduceat(e0, first), np.add.reduceat(e1, first), np.maximum.reduceat(run, first), np.minimum.reduceat(run, first)

    return _mapped(df, text, model, "sum0 bigint; sum1 bigint; max_prefix bigint; min_prefix bigint", work)


def segment_score_sums(lines: DataFrame, model: L.Model) -> DataFrame:
    """(k, n, sum_score, max_score, min_score) of the CRF's scores of all spans of each length. Every task sends a row a length."""
    import copy

    crf = copy.copy(model)
    crf.lambda0 = 0
    shared = lines.sparkSession.sparkContext.broadcast(crf)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, total = np.zeros(m.max_len, np.int64), np.zeros(m.max_len, np.int64)
        top, low = np.full(m.max_len, -(1 << 62)), np.full(m.max_len, 1 << 62)
        for b in parts:
            texts = [t for t in b.column(0).to_pylist() if t]
            for part in L.batches(texts):
                lat = L.Lattice([texts[k] for k in part], m.table, m.max_len)
                scores = lat.joint_scores(m)
                for k in range(m.max_len):
                    s = scores[k, lat.pos > k]
                    if len(s):
                        n[k], total[k], top[k], low[k] = n[k] + len(s), total[k] + s.sum(), max(top[k], s.max()), min(low[k], s.min())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some + 1), *(pa.array(x[some]) for x in (n, total, top, low))], ["k", "n", "sum_score", "max_score", "min_score"])

    rows = map_arrow(spread(lines.select("line")), work, "k bigint, n bigint, sum_score bigint, max_score bigint, min_score bigint")
    return rows.groupBy("k").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "sum_score"), (F.max, "max_score"), (F.min, "min_score"))))


def seed_of(base: int, *keys: Column) -> Column:
    """A seed from 1 to 2**32 - 1 for each row, by its keys alone, so that no order of rows matters."""
    return (F.pmod(F.xxhash64(F.lit(base), *keys), F.lit(0xFFFFFFFF)) + 1).cast("bigint")


def _seeds(b: pa.RecordBatch, at: int, rows: np.ndarray) -> np.ndarray:
    return b.column(at).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32)


def tokenize_sample(df: DataFrame, model: L.Model, temperature: float = 1.0, seed: str = "seed", text: str = "line", sep: str | None = None) -> DataFrame:
    """df with a segmentation drawn with the seeds of a column, and its score. sep is as in tokenize()."""
    at = df.columns.index(seed)
    add, words = _words(sep)

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        mark, _, _, score = L.drawn_marks(lat, m, temperature, _seeds(b, at, rows), np.arange(len(rows)))
        return *words(lat, mark[0]), score[lat.order]

    return _mapped(df, text, model, f"{add}; score bigint", work)


def samples_joined(df: DataFrame, model: L.Model, temperature: float, seeds: dict[int, str], sep: str, text: str = "line") -> DataFrame:
    """A row for each text and number of `seeds`, whose columns have the seeds: rep, score, n_tokens and the tokens joined. A text's sums of paths are made once for all its draws; null and empty texts have no row."""
    at, reps = [df.columns.index(c) for c in seeds.values()], np.array(list(seeds))

    def work(m: L.Model, lat: L.Lattice, b: pa.RecordBatch, rows: np.ndarray) -> tuple:
        n = len(rows)
        mark, layer, row, score = L.drawn_marks(lat, m, temperature, np.concatenate([_seeds(b, k, rows) for k in at]), np.tile(np.arange(n), len(at)))
        where = layer * n + row
        counts = np.concatenate([L.word_counts(lat, x) for x in mark])[where]
        return row, np.repeat(reps, n), score, counts, pa.concat_arrays([L.joined_words(lat, x, sep) for x in mark]).take(pa.array(where))

    return _mapped(df, text, model, "rep int; score bigint; n_tokens bigint; joined string", work, lattices=True)


def pick_from_nbest(nbest: Column, seed: Column) -> Column:
    """One of the n-best lists' members, all equally likely."""
    from lexweave.functions.text import xorshift32

    return F.element_at(nbest, (F.pmod(xorshift32(seed), F.size(nbest)) + 1).cast("int"))


def with_offsets(tokens: Column, unit: str = "char") -> Column:
    """An array of (token, start, end), offsets in code points or bytes."""
    from lexweave.functions.text import byte_boundaries, char_boundaries

    if unit in ("char", "cp", "codepoint"):
        ends = char_boundaries(tokens)
    elif unit in ("byte", "bytes"):
        ends = byte_boundaries(tokens)
    else:
        raise ValueError(f"unit {unit!r}: char or byte")
    n = F.size(tokens)
    starts, stops = F.slice(ends, F.lit(1), n), F.slice(ends, F.lit(2), n)
    return F.transform(F.arrays_zip(tokens.alias("token"), starts.alias("start"), stops.alias("end")), lambda x: x)


def boundary_scores(found: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """(precision, recall, f1, tokens_per_sentence, token_length) of word starts; both sides have key columns and tokens."""
    ends = lambda d: d.select(*key, F.explode(_starts_of(F.col("tokens"))).alias("at"))
    both = ends(found).withColumn("f", F.lit(1)).join(ends(gold).withColumn("g", F.lit(1)), [*key, "at"], "full_outer")
    sums = both.agg(F.sum("f").alias("f"), F.sum("g").alias("g"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    sizes = found.agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.aggregate("tokens", F.lit(0), lambda a, t: a + F.char_length(t))).alias("chars"))
    p, r = F.col("hit") / F.col("f"), F.col("hit") / F.col("g")
    return sums.crossJoin(sizes).select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"), (F.col("tokens") / F.col("sentences")).alias("tokens_per_sentence"), (F.col("chars") / F.col("tokens")).alias("token_length"))


def _starts_of(tokens: Column) -> Column:
    from lexweave.functions.text import char_boundaries

    return F.slice(char_boundaries(tokens), F.lit(1), F.size(tokens))
