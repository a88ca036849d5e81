"""Models as Parquet tables, as the little-endian binary file of the command-line tools, and as a C header."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import SparkSession

from lexweave.functions.text import ClassRange
from lexweave.operators.lattice import Model

MODES = {name: k for k, name in enumerate(("ascii", "utf8len", "ranges", "compat"))}
MODE_FLAGS = {"ascii": 1 << 8, "utf8len": 1 << 9, "ranges": 1 << 10, "compat": 1 << 11}
SCALARS = ("max_len", "lambda0", "unk_base", "unk_per_cp", "trans00", "trans01", "trans10", "trans11", "bos_to1")


class ModelFileError(ValueError):
    """What is wrong with a model file, with a code for each kind of fault."""

    def __init__(self, code: int, why: str) -> None:
        super().__init__(f"{why} ({code})")
        self.code = code


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Writes vocab, crf_feat, bigram, cc_ranges and model_params under path."""
    logp = [None] * len(model.pieces) if model.logp is None else [float(x) for x in model.logp]
    spark.createDataFrame([(k, p, int(q), lp) for k, (p, q, lp) in enumerate(zip(model.pieces, model.logp_q, logp))], "piece_id int, piece string, logp_q int, logp double").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(int(k), int(w)) for k, w in sorted(model.crf.items())], "key bigint, weight_q int").coalesce(1).write.mode("overwrite").parquet(f"{path}/crf_feat")
    spark.createDataFrame([(a, b, q) for (a, b), q in sorted(model.bigrams.items())], "prev_id int, cur_id int, logp_q int").coalesce(1).write.mode("overwrite").parquet(f"{path}/bigram")
    spark.createDataFrame([(r.lo, r.hi, r.class_id) for r in model.cc_ranges], "lo int, hi int, class_id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cc_ranges")
    params = {s: getattr(model, s) for s in (*SCALARS, "flags")}, {s: getattr(model, s) for s in ("cc_mode", "cc_fallback")}
    spark.createDataFrame([(*params[0].values(), *params[1].values())], ", ".join([*(f"{s} int" for s in params[0]), *(f"{s} string" for s in params[1])])).coalesce(1).write.mode("overwrite").parquet(f"{path}/model_params")


def load(spark: SparkSession, path: str) -> Model:
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("piece_id").toPandas()
    crf = {r[0]: r[1] for r in spark.read.parquet(f"{path}/crf_feat").collect()}
    bigrams = {(r[0], r[1]): r[2] for r in spark.read.parquet(f"{path}/bigram").collect()}
    params = spark.read.parquet(f"{path}/model_params").first().asDict()
    ranges = tuple(ClassRange(*r) for r in spark.read.parquet(f"{path}/cc_ranges").orderBy("lo").collect()) if "cc_mode" in params else ()
    logp = None if vocab["logp"].isna().any() else vocab["logp"].to_numpy()
    return Model(vocab["piece"].tolist(), vocab["logp_q"].to_numpy(np.int64), crf, bigrams=bigrams, logp=logp, cc_ranges=ranges, **params)


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """base and check of a trie: the root is 1, a key ends in a child of code 0 whose base is -(number + 1)."""
    tree: dict = {}
    for number, key in enumerate(keys):
        if not key or 0 in key:
            raise ValueError("a key is empty or has a NUL")
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[0] = number
    size = 1024
    base, check = np.zeros(size, np.int32), np.zeros(size, np.int32)
    check[1] = 1
    todo, first = [(1, tree)], 1
    while todo:
        at, node = todo.pop()
        codes = np.array(sorted(node))
        b = max(1, first - int(codes[0]))
        while True:
            if b + 256 >= len(base):
                base, check = np.concatenate([base, np.zeros(len(base), np.int32)]), np.concatenate([check, np.zeros(len(check), np.int32)])
            if (check[b + codes] == 0).all() and 0 not in b + codes:
                break
            b += 1
        base[at] = b
        check[b + codes] = at
        while first < len(check) and check[first]:
            first += 1
        for c in node:
            if c == 0:
                base[b] = -(node[0] + 1)
            else:
                todo.append((b + c, node[c]))
    return base, check


def keys_of(base: np.ndarray, check: np.ndarray) -> dict[int, bytes]:
    """The keys of a trie by number."""
    children: dict[int, list[int]] = {}
    for k in np.flatnonzero(check):
        if k != check[k]:
            children.setdefault(int(check[k]), []).append(int(k))
    out, todo = {}, [(1, b"")]
    while todo:
        at, key = todo.pop()
        for k in children.get(at, []):
            c = k - int(base[at])
            if c == 0 and base[k] < 0:
                out[-int(base[k]) - 1] = key
            elif 0 < c < 256:
                todo.append((k, key + bytes([c])))
    return out


def to_bytes(model: Model, magic: bytes = b"LEXW") -> bytes:
    """The model as a version-2 file; magic is the four letters that its readers ask for."""
    flags, ranges = model.flags | MODE_FLAGS[model.cc_mode], model.cc_ranges
    mode, fallback = MODES[model.cc_mode], MODES[model.cc_fallback]
    base, check = double_array([p.encode() for p in model.pieces])
    feats = sorted(model.crf.items())
    bigrams = sorted((a << 16 | b, q) for (a, b), q in model.bigrams.items())
    head = magic + b"v2\0\0" + struct.pack("<5I", 2, 4, len(base), len(model.pieces), model.max_len)
    head += struct.pack("<8h", model.unk_base, model.unk_per_cp, model.lambda0, model.trans00, model.trans01, model.trans10, model.trans11, model.bos_to1)
    head += struct.pack("<3I2B2xI", len(feats), len(bigrams), flags, mode, fallback, len(ranges))
    body = base.astype("<i4").tobytes() + check.astype("<i4").tobytes() + np.asarray(model.logp_q, "<i2").tobytes()
    body += np.array([k for k, _ in bigrams], "<u4").tobytes() + np.array([q for _, q in bigrams], "<i2").tobytes()
    body += np.array([k for k, _ in feats], "<u4").tobytes() + np.array([w for _, w in feats], "<i2").tobytes()
    return head + body + b"".join(struct.pack("<IIB3x", r.lo, r.hi, r.class_id) for r in ranges)


def from_bytes(data: bytes) -> Model:
    """The model of a version-1 or version-2 file. Files of version 1 say nothing of classes; their readers take those by the length of characters in UTF-8."""
    if len(data) < 52:
        raise ModelFileError(-11, "too short for a header")
    tail = data[4:8]
    if tail not in (b"v1\0\0", b"v2\0\0"):
        raise ModelFileError(-12, "not a model file")
    version, width, cap, vocab, max_len = struct.unpack_from("<5I", data, 8)
    if version != (1 if tail[1:2] == b"1" else 2):
        raise ModelFileError(-13, "its version isn't that of its name")
    if width != 4:
        raise ModelFileError(-14, "trie numbers aren't of 4 bytes")
    if not cap or not vocab or not max_len:
        raise ModelFileError(-15, "no vocabulary")
    numbers = struct.unpack_from("<8h", data, 28)
    n_feat, n_bi = struct.unpack_from("<2I", data, 44)
    flags, mode, fallback, n_range, at = 0, MODES["utf8len"], MODES["ascii"], 0, 52
    if version == 2:
        if len(data) < 64:
            raise ModelFileError(-16, "too short for a header")
        flags, mode, fallback, n_range = struct.unpack_from("<I2B2xI", data, 52)
        at = 64
        if mode >= len(MODES) or fallback >= len(MODES):
            raise ModelFileError(-17, "an unknown mode of character classes")
    parts = []
    for kind, n in (("<i4", cap), ("<i4", cap), ("<i2", vocab), ("<u4", n_bi), ("<i2", n_bi), ("<u4", n_feat), ("<i2", n_feat)):
        size = np.dtype(kind).itemsize * n
        if at + size > len(data):
            raise ModelFileError(-19, "an array is cut off")
        parts.append(np.frombuffer(data, kind, n, at))
        at += size
    if at + 12 * n_range > len(data):
        raise ModelFileError(-19, "the ranges are cut off")
    ranges = tuple(ClassRange(*struct.unpack_from("<IIB3x", data, at + 12 * k)) for k in range(n_range))
    base, check, logp, bi_key, bi_q, f_key, f_w = parts
    keys = keys_of(base, check)
    pieces = [keys.get(k, b"").decode("utf-8", "replace") for k in range(vocab)]
    unk_base, unk_per_cp, lambda0, t00, t01, t10, t11, bos = numbers
    bigrams = {(int(k) >> 16, int(k) & 0xFFFF): int(q) for k, q in zip(bi_key, bi_q)}
    return Model(pieces, logp.astype(np.int64), {int(k): int(w) for k, w in zip(f_key, f_w)}, max_len, lambda0, unk_base, unk_per_cp, t00, t01, t10, t11, bos, bigrams, flags=flags, cc_mode=list(MODES)[mode], cc_fallback=list(MODES)[fallback], cc_ranges=ranges)


def c_header(model: Model, symbol: str = "model") -> str:
    """All of the model as static arrays and constants of a C header."""
    base, check = double_array([p.encode() for p in model.pieces])
    feats, bigrams = sorted(model.crf.items()), sorted((a << 16 | b, q) for (a, b), q in model.bigrams.items())

    def array(kind: str, name: str, values) -> str:
        values = [str(int(v)) for v in values] or ["0"]
        rows = [", ".join(values[k : k + 16]) for k in range(0, len(values), 16)]
        return f"static const {kind} {symbol}_{name}[{len(values)}] = {{\n  " + ",\n  ".join(rows) + "\n};\n"

    out = ["#pragma once\n\n#include <stdint.h>\n"]
    for kind, name, values in (
        ("int32_t", "base", base), ("int32_t", "check", check), ("int16_t", "logp_uni", model.logp_q), ("uint32_t", "bigram_key", [k for k, _ in bigrams]), ("int16_t", "logp_bi", [q for _, q in bigrams]), ("uint32_t", "feat_key", [k for k, _ in feats]), ("int16_t", "feat_w", [w for _, w in feats])
    ):
        out.append(array(kind, name, values))
    if model.cc_ranges:
        rows = ",\n  ".join(f"{{{r.lo}u, {r.hi}u, {r.class_id}}}" for r in model.cc_ranges)
        out.append(f"static const struct {{ uint32_t lo, hi; uint8_t class_id; }} {symbol}_cc_ranges[{len(model.cc_ranges)}] = {{\n  {rows}\n}};\n")
    modes = {"flags": model.flags | MODE_FLAGS[model.cc_mode], "cc_mode": MODES[model.cc_mode], "cc_fallback": MODES[model.cc_fallback], "cc_range_count": len(model.cc_ranges)}
    sizes = {"capacity": len(base), "vocab_size": len(model.pieces), "bigram_size": len(bigrams), "feat_count": len(feats)} | {s: getattr(model, s) for s in SCALARS} | modes
    out.append("enum {\n" + "".join(f"  {symbol}_{k} = {v},\n" for k, v in sizes.items()) + "};\n")
    return "\n".join(out)
