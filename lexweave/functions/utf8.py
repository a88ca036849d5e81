"""UTF-8 repair of binary columns, for input that isn't valid text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(data: bytes, fallback: str = "?") -> str:
    """data as text: an invalid byte and each code that is a surrogate or too large become the fallback, overlong forms what they stand for."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i, n = [], 0, len(data)
    while i < n:
        b = data[i]
        size = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 0
        tail = data[i + 1 : i + size]
        if not size or len(tail) < size - 1 or any(c >> 6 != 2 for c in tail):
            out.append(fallback)
            i += 1
            continue
        cp = b if size == 1 else b & (0x7F >> size)
        for c in tail:
            cp = cp << 6 | c & 0x3F
        out.append(fallback if 0xD800 <= cp <= 0xDFFF or cp > 0x10FFFF else chr(cp))
        i += size
    return "".join(out)


def normalize_utf8(data: Column, fallback: str = "?") -> Column:
    """A binary column as valid text. Valid values are cast without Python; only the others are repaired."""

    @F.pandas_udf("string")
    def repair(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else repaired(v, fallback))

    return F.when(F.is_valid_utf8(data), data.cast("string")).otherwise(repair(F.when(F.is_valid_utf8(data), F.lit(None)).otherwise(data)))
