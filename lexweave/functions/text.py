"""Column functions over text: character classes, reversible white space, fixed point, keys, random numbers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

META = "▀▁▂▃▄"
#: Noncharacters that stand in for escaped meta characters while the others are replaced.
_STAND_INS = "﷐﷑﷒﷓﷔"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


@dataclass(frozen=True)
class ClassRange:
    lo: int
    hi: int
    class_id: int


def characters(text: Column) -> Column:
    """The text's characters as an array; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def code_point(ch: Column) -> Column:
    return F.ascii(ch)


def _ascii_class(cp: Column) -> Column:
    return F.when(cp.isin(32, 9, 10, 13), 1).when(cp.between(48, 57), 2).when(cp.between(65, 90) | cp.between(97, 122), 3).otherwise(8)


def _utf8len_class(cp: Column) -> Column:
    return F.when(cp < 0x800, 9).when(cp < 0x10000, 10).otherwise(11)


def char_class(cp: Column, mode: str = "compat", ranges: tuple[ClassRange, ...] = (), fallback: str = "utf8len") -> Column:
    """The class of a code point. Modes: ascii, utf8len, ranges (with a fallback, ascii or utf8len) and compat."""
    if mode == "ascii":
        rest = F.lit(0)
    elif mode == "utf8len":
        rest = _utf8len_class(cp)
    elif mode == "ranges":
        other = _utf8len_class(cp) if fallback == "utf8len" else F.lit(0)
        rest = other
        for r in reversed(ranges):
            rest = F.when(cp.between(r.lo, r.hi), F.lit(r.class_id) if r.class_id else other).otherwise(rest)
    elif mode == "compat":
        rest = F.when(cp.between(0x3040, 0x309F), 4).when(cp.between(0x30A0, 0x30FF), 5).when(cp.between(0x4E00, 0x9FFF), 6).when(cp.between(0xFF00, 0xFFEF), 7).otherwise(0)
    else:
        raise ValueError(f"mode {mode!r}: ascii, utf8len, ranges or compat")
    return F.when(cp.between(0x2580, 0x2584), 1).when(cp <= 0x7F, _ascii_class(cp)).otherwise(rest).cast("int")


def gold_class(cp: Column) -> Column:
    """The class that segmented training text is read with: wider than compat, and ASCII punctuation is of none."""
    return (
        F.when(cp.isin(32, 9, 10, 13), 1)
        .when(cp.between(48, 57) | cp.between(0xFF10, 0xFF19), 2)
        .when(cp.between(65, 90) | cp.between(97, 122) | cp.between(0xFF21, 0xFF3A) | cp.between(0xFF41, 0xFF5A), 3)
        .when(cp.between(0x3040, 0x309F), 4)
        .when(cp.between(0x30A0, 0x30FF) | cp.between(0x31F0, 0x31FF), 5)
        .when(cp.between(0x4E00, 0x9FFF) | cp.between(0x3400, 0x4DBF), 6)
        .when(cp.between(0xFF01, 0xFF60), 7)
        .when(cp.between(0x2000, 0x206F) | cp.between(0x3000, 0x303F) | cp.between(0xFF61, 0xFF65), 8)
        .otherwise(0)
        .cast("int")
    )


def lossless_encode(text: Column, newlines: bool = True) -> Column:
    """White space as visible meta characters, which are escaped where they stand in the text themselves."""
    escaped = F.when(_holds(text, META), F.regexp_replace(text, f"([{META}])", "▀$1")).otherwise(text)
    return _replaced(escaped, " \t\n\r", "▁▂▃▄") if newlines else _replaced(escaped, " \t", "▁▂")


def _holds(text: Column, letters: str) -> Column:
    """Whether some of these characters are in the text, without a regular expression."""
    return reduce(lambda a, b: a | b, (text.contains(c) for c in letters))


def _replaced(text: Column, letters: str, by: str) -> Column:
    """translate() of a few characters, none of which is made by another."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), zip(letters, by), text)


def _decode_by_fold(text: Column) -> Column:
    plain = lambda c: F.translate(c, "▁▂▃▄", " \t\n\r")
    end = F.aggregate(
        characters(text),
        F.struct(F.lit(False).alias("esc"), F.lit("").alias("out")),
        lambda s, c: F.when(s["esc"], F.struct(F.lit(False).alias("esc"), F.concat(s["out"], c).alias("out")))
        .when(c == "▀", F.struct(F.lit(True).alias("esc"), s["out"].alias("out")))
        .otherwise(F.struct(F.lit(False).alias("esc"), F.concat(s["out"], plain(c)).alias("out"))),
    )
    return F.concat(end["out"], F.when(end["esc"], "▀").otherwise(""))


def lossless_decode(text: Column) -> Column:
    """The inverse of lossless_encode. An escape with nothing after it stays.

    Linear in the text, but for one that holds the stand-ins themselves. Only texts with an escape need regular expressions.
    """
    plain = _replaced(text, "▁▂▃▄", " \t\n\r")
    x = F.regexp_replace(text, "▀▀", _STAND_INS[0])
    for meta, stand in zip(META[1:], _STAND_INS[1:]):
        x = F.regexp_replace(x, f"▀{meta}", stand)
    x = F.regexp_replace(x, "(?s)▀(.)", "$1")
    x = F.translate(F.translate(x, "▁▂▃▄", " \t\n\r"), _STAND_INS, META)
    return F.when(~text.contains("▀"), plain).when(text.rlike(f"[{_STAND_INS}]"), _decode_by_fold(text)).otherwise(x)


def detokenize(tokens: Column) -> Column:
    """The text of an array of tokens, joined before it is decoded."""
    return lossless_decode(F.array_join(tokens, ""))


def detok_line(line: Column) -> Column:
    """A line of tokens apart by blanks or tabs as text that ends with a newline."""
    out = lossless_decode(F.regexp_replace(line, "[ \t]+", ""))
    return F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


def feature_key(template: Column, label: Column, v1: Column, v2: Column) -> Column:
    big = lambda c: c.cast("bigint")
    return F.shiftleft(big(template), 24).bitwiseOR(F.shiftleft(big(label), 16)).bitwiseOR(F.shiftleft(big(v1), 8)).bitwiseOR(big(v2))


def quantize(x: Column) -> Column:
    """A double as Q8.8 fixed point, ties to even, clamped to 16 bits."""
    return F.rint(F.least(F.greatest(x * 256, F.lit(-32768.0)), F.lit(32767.0))).cast("int")


def dequantize(q: Column) -> Column:
    return q.cast("double") / 256


def q_multiply(a: Column, b: Column) -> Column:
    return F.shiftright(a.cast("bigint") * b.cast("bigint"), 8)


def xorshift32(x: Column) -> Column:
    """The next state of the generator, as a bigint of 32 bits."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)


def uniform(state: Column) -> Column:
    """A state as a number from 0 up to 1."""
    return F.shiftright(state, 8).cast("double") / float(1 << 24)


def byte_boundaries(tokens: Column) -> Column:
    """Byte offsets of the tokens' ends, with 0 in front."""
    return F.aggregate(tokens, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(t))))


def char_boundaries(tokens: Column) -> Column:
    """Offsets of the tokens' ends in code points, with 0 in front."""
    return F.aggregate(tokens, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(t))))
