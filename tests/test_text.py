"""Column functions and sources."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.utf8 import repaired
from lexweave.sources import corpus as C


def values(spark, expr, inputs, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in inputs], schema).select(expr(F.col("x"))).collect()]


def test_classes(spark):
    chars = list(" 7aあア漢Ａ.é、▁😀㐀")
    of = lambda *a: values(spark, lambda c: T.char_class(T.code_point(c), *a), chars)
    assert of() == [1, 2, 3, 4, 5, 6, 7, 8, 0, 0, 1, 0, 0]
    assert of("ascii") == [1, 2, 3, 0, 0, 0, 0, 8, 0, 0, 1, 0, 0]
    assert of("utf8len") == [1, 2, 3, 10, 10, 10, 10, 8, 9, 10, 1, 11, 10]
    assert of("ranges", C.parse_ranges("0x3040 0x309F 4"), "ascii") == [1, 2, 3, 4, 0, 0, 0, 8, 0, 0, 1, 0, 0]
    gold = values(spark, lambda c: T.gold_class(T.code_point(c)), list(".、Ａ１！㐀ㇰ▁"))
    assert gold == [0, 8, 3, 2, 7, 6, 5, 0]
    with pytest.raises(ValueError):
        T.char_class(F.lit(1), "other")


def test_codec(spark):
    assert values(spark, T.lossless_encode, ["a b", "\t\n\r", "x▁y ▀z", None]) == ["a▁b", "▂▃▄", "x▀▁y▁▀▀z", None]
    assert values(spark, T.lossless_decode, ["▀", "a▀", "▀x", "▀▀▁", "▀▁▁", "", "▀▀▀▁"]) == ["▀", "a▀", "x", "▀ ", "▁ ", "", "▀▁"]
    stand_in = chr(0xFDD0)
    assert values(spark, T.lossless_decode, [stand_in + "▀▀▁"]) == [stand_in + "▀ "]
    assert values(spark, T.detok_line, ["a▁b c", "x▃", ""]) == ["a bc\n", "x\n", "\n"]


ALPHABET = st.text(alphabet="a \t\n\r▀▁▂▃▄漢😀" + chr(0xFDD0), max_size=30)


@settings(max_examples=8, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=60))
def test_round_trip(spark, texts):
    assert values(spark, lambda c: T.lossless_decode(T.lossless_encode(c)), texts) == texts


def test_numbers(spark):
    assert values(spark, T.quantize, [0.2, -0.6, 2.5 / 256, 1e9, -1e9], "x double") == [51, -154, 2, 32767, -32768]
    assert values(spark, T.xorshift32, [1], "x bigint") == [270369]
    row = spark.range(1).select(T.feature_key(F.lit(1), F.lit(1), F.lit(250), F.lit(0)), T.q_multiply(F.lit(-385), F.lit(1))).first()
    assert tuple(row) == (16906752, -2)


def test_repair():
    assert [repaired(x) for x in (b"\xc0\xaf", b"\xed\xa0\x80", b"\xff", b"\xe3\x81", "é漢😀".encode())] == ["/", "?", "?", "??", "é漢😀"]
    assert repaired(b"a\xf4\x90\x80\x80b", "□") == "a□b"


def test_lines(spark):
    docs = spark.createDataFrame([(1, "a  \r\n\n  b\t\n \n"), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, C.corpus_lines(docs).collect())) == [(1, 0, "a"), (1, 2, "  b")]
    assert sorted(map(tuple, C.tokenizer_lines(docs).collect())) == [(1, 0, "a  "), (1, 2, "  b\t"), (1, 3, " ")]
    lines = spark.createDataFrame([(1, 0, "x" * 2048), (1, 1, "x" * 2049), (1, 2, "é" * 2048), (1, 3, "é" * 2049)], "doc_id bigint, line_no bigint, line string")
    assert sorted(r.line_no for r in C.within_limits(lines).collect()) == [0, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert sorted(r.text for r in C.text_file(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert C.text_file(spark, str(tmp_path), whole=True).first().text == "one\ntwo\n"
    assert C.one_text(spark, "a", "b").first().text == "a b"


def test_parsers():
    assert [(r.lo, r.hi, r.class_id) for r in C.parse_ranges("# c\n0x30 57 2\n 010 9 1 # x\n")] == [(8, 9, 1), (48, 57, 2)]
    for bad in ("5 4 1", "0 0x110000 1", "1 2 256", "1 2", "1 5 1\n5 6 2"):
        with pytest.raises(ValueError):
            C.parse_ranges(bad)
    scalars, weights, other = C.parse_crf_config("trans00 = 0.5 # c\n; c\nfeat 1 1 250 0 = -2\nbos_to1=1\nnonsense\nfeat 1 = 2")
    assert scalars == {"trans00": 0.5, "bos_to1": 1.0} and weights == {16906752: -2.0} and len(other) == 2
