"""Queries over lines, characters, classes and the reversible codec, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.utf8 import normalize_utf8
from lexweave.sources import corpus as C

#: Characters of classes that the tables lack.
FIXTURE = " \t7aあア漢Ａ.é、▁😀㐀１！ㇰ"
#: Texts with tabs, returns, meta characters and lone escapes.
CODEC = ("a b\tc", "x▁y ▀z", "line\r\nnext", "▀", "a▀", "▀▀▁ ▄", "漢字 かな▃", "")
DETOK = ("a▁b c", "x ▀▁ y\tz", "▁", "end▃", "▀ ▁")
RANGES = "0x3040 0x309F 4\n0x4E00 0x9FFF 6  # ideographs\n0xC0 0x17F 3\n"

LINES = """lines AS (
  SELECT d.doc_id, u.i - 1 AS line_no, rtrim(d.parts[u.i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(d.parts) + 1)) AS u(i)
  WHERE rtrim(d.parts[u.i], ' ' || chr(9) || chr(13)) <> '')"""

CHARS = LINES + """, chars AS (
  SELECT l.doc_id, l.line_no, u.i, l.c[u.i] AS ch
  FROM (SELECT doc_id, line_no, string_split(line, '') AS c FROM lines) l, unnest(range(1, len(l.c) + 1)) AS u(i))"""


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_lines(docs_of(spark, sf_dir).select("doc_id", "text"))


def quoted(s: str) -> str:
    """A string as a DuckDB expression."""
    parts = "".join(f"' || chr({ord(c)}) || '" if ord(c) < 32 else c.replace("'", "''") for c in s)
    return f"('{parts}')"


def ascii_class_sql(cp: str) -> str:
    return f"CASE WHEN {cp} IN (32, 9, 10, 13) THEN 1 WHEN {cp} BETWEEN 48 AND 57 THEN 2 WHEN {cp} BETWEEN 65 AND 90 OR {cp} BETWEEN 97 AND 122 THEN 3 ELSE 8 END"


def class_sql(cp: str, mode: str = "compat") -> str:
    long = f"CASE WHEN {cp} < 2048 THEN 9 WHEN {cp} < 65536 THEN 10 ELSE 11 END"
    rest = {
        "ascii": "0",
        "utf8len": long,
        "ranges": f"CASE WHEN {cp} BETWEEN 12352 AND 12447 THEN 4 WHEN {cp} BETWEEN 19968 AND 40959 THEN 6 WHEN {cp} BETWEEN 192 AND 383 THEN 3 ELSE {long} END",
        "compat": f"CASE WHEN {cp} BETWEEN 12352 AND 12447 THEN 4 WHEN {cp} BETWEEN 12448 AND 12543 THEN 5 WHEN {cp} BETWEEN 19968 AND 40959 THEN 6 WHEN {cp} BETWEEN 65280 AND 65519 THEN 7 ELSE 0 END",
    }[mode]
    return f"CASE WHEN {cp} BETWEEN 9600 AND 9604 THEN 1 WHEN {cp} <= 127 THEN {ascii_class_sql(cp)} ELSE {rest} END"


def gold_class_sql(cp: str) -> str:
    return f"""CASE WHEN {cp} IN (32, 9, 10, 13) THEN 1 WHEN {cp} BETWEEN 48 AND 57 OR {cp} BETWEEN 65296 AND 65305 THEN 2
      WHEN {cp} BETWEEN 65 AND 90 OR {cp} BETWEEN 97 AND 122 OR {cp} BETWEEN 65313 AND 65338 OR {cp} BETWEEN 65345 AND 65370 THEN 3
      WHEN {cp} BETWEEN 12352 AND 12447 THEN 4 WHEN {cp} BETWEEN 12448 AND 12543 OR {cp} BETWEEN 12784 AND 12799 THEN 5
      WHEN {cp} BETWEEN 19968 AND 40959 OR {cp} BETWEEN 13312 AND 19903 THEN 6 WHEN {cp} BETWEEN 65281 AND 65376 THEN 7
      WHEN {cp} BETWEEN 8192 AND 8303 OR {cp} BETWEEN 12288 AND 12351 OR {cp} BETWEEN 65377 AND 65381 THEN 8 ELSE 0 END"""


def encode_sql(x: str) -> str:
    return f"translate(regexp_replace({x}, '([▀▁▂▃▄])', '▀\\1', 'g'), ' ' || chr(9) || chr(10) || chr(13), '▁▂▃▄')"


def decode_sql(x: str) -> str:
    x = f"replace({x}, '▀▀', chr(64976))"
    for k, meta in enumerate("▁▂▃▄", 64977):
        x = f"replace({x}, '▀{meta}', chr({k}))"
    x = f"translate(regexp_replace({x}, '▀(.)', '\\1', 'gs'), '▁▂▃▄', ' ' || chr(9) || chr(10) || chr(13))"
    return f"translate({x}, chr(64976) || chr(64977) || chr(64978) || chr(64979) || chr(64980), '▀▁▂▃▄')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(CODEC)], "doc_id bigint, text string")
    return docs_of(spark, sf_dir).select("doc_id", "text").unionByName(extra)


TEXTS = "texts AS (SELECT doc_id, text FROM documents" + "".join(f" UNION ALL SELECT {-1 - k}, {quoted(t)}" for k, t in enumerate(CODEC)) + ")"


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir)


def line_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    long_bytes, long_cp = F.octet_length("line") > 4096, F.char_length("line") > 2048
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(long_bytes).alias("skipped_bytes"), F.count_if(~long_bytes & long_cp).alias("skipped_cp"), F.count_if(~long_bytes & ~long_cp).alias("kept"))


def limited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.within_limits(lines_of(spark, sf_dir))


def eol_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_eol(lines_of(spark, sf_dir))


def tokenizer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokenizer_lines(docs_of(spark, sf_dir))


def read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = T.lossless_encode(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.md5(encoded).alias("encoded_md5"), F.char_length(encoded).cast("bigint").alias("n_cp"), F.octet_length(encoded).cast("bigint").alias("n_bytes"))


def _char_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators.vocabulary import codepoint_counts

    seen = codepoint_counts(C.spread(lines_of(spark, sf_dir))).select("ch")
    return seen.union(spark.createDataFrame([(c,) for c in FIXTURE], "ch string")).distinct().withColumn("cp", T.code_point(F.col("ch")))


def _classes(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _char_rows(spark, sf_dir).select("ch", F.col("cp").cast("bigint").alias("cp"), make(F.col("cp")).cast("bigint").alias("cls"))

    return query


_ALL_CHARS = f"WITH {CHARS}, seen AS (SELECT DISTINCT ch FROM chars UNION SELECT unnest(string_split({quoted(FIXTURE)}, '')))"


def class_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.plans.segment_queries import contexts

    return contexts(lines_of(spark, sf_dir))


def codepoint_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators.vocabulary import codepoint_counts

    return codepoint_counts(C.spread(lines_of(spark, sf_dir)))


def distinct_codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codepoint_freq(spark, sf_dir).agg(F.count("*").alias("n_distinct"), F.sum("cnt").alias("n_total"))


def lossless_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.lossless_encode(F.col("text"))).alias("encoded_md5"), F.md5(T.lossless_encode(F.col("text"), newlines=False)).alias("blanks_md5"))


def lossless_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.lossless_decode(F.col("text"))).alias("decoded_md5"), F.char_length(T.lossless_decode(F.col("text"))).cast("bigint").alias("n_cp"))


def lossless_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = T.lossless_decode(T.lossless_encode(F.col("text")))
    return _texts(spark, sf_dir).select("doc_id", (again == F.col("text")).alias("same"), F.md5(again).alias("text_md5"))


def detok_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir).unionByName(spark.createDataFrame([(-1 - k, 0, t) for k, t in enumerate(DETOK)], "doc_id bigint, line_no bigint, line string"))
    return lines.select("doc_id", "line_no", F.md5(T.detok_line(F.col("line"))).alias("text_md5"))


def xorshift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("doc_id") + 1).cast("bigint")
    a = T.xorshift32(x)
    b = T.xorshift32(a)
    return docs_of(spark, sf_dir).select("doc_id", a.alias("s1"), b.alias("s2"), T.uniform(b).alias("u2"))


def utf8_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = spark.createDataFrame([(-1, bytearray(b"\xc0\xaf")), (-2, bytearray(b"\xed\xa0\x80x")), (-3, bytearray(b"\xff")), (-4, bytearray(b"\xe3\x81"))], "doc_id bigint, data binary")
    all_ = docs_of(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("data")).unionByName(bad)
    return all_.select("doc_id", normalize_utf8(F.col("data")).alias("text"))


def prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in KEYS], "key string")
    per = docs_of(spark, sf_dir).select(*(F.regexp_count("text", F.lit(f"(?={k})")).cast("bigint").alias(k) for k in KEYS)).agg(*(F.sum(k).alias(k) for k in KEYS))
    one = per.select(F.create_map(*(x for k in KEYS for x in (F.lit(k), F.col(k)))).alias("m"))
    return keys.crossJoin(F.broadcast(one)).select("key", F.element_at("m", F.col("key")).alias("cnt"))


KEYS = ("the", "tion", "an", "ana", "é", "ou")


def bigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.sum(F.regexp_count("text", F.lit(f"(?={k})")).cast("bigint"))
    return docs_of(spark, sf_dir).agg(n("th").alias("forward"), n("the").alias("forward_back"))


def ngram_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.spread(docs_of(spark, sf_dir).select("text")).select(T.characters(F.col("text")).alias("c"))
    nxt = F.concat(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), F.array(F.lit("")))
    pairs = c.filter("size(c) > 0").select(F.explode(F.zip_with("c", nxt, lambda a, b: F.concat(a, b))).alias("prefix"))
    return pairs.groupBy("prefix").agg(F.count("*").alias("cnt"))


_DOC_CHARS = """doc_chars AS (SELECT d.doc_id, u.i, d.c[u.i] AS ch FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text <> '') d, unnest(range(1, len(d.c) + 1)) AS u(i)),
  led AS (SELECT ch, coalesce(lead(ch, 1) OVER w, '') AS c1, coalesce(lead(ch, 2) OVER w, '') AS c2, coalesce(lead(ch, 3) OVER w, '') AS c3 FROM doc_chars WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

_SHIFT = "xor(xor({x}, ({x} << 13) & 4294967295), xor({x}, ({x} << 13) & 4294967295) >> 17)"


def _xs_sql(x: str) -> str:
    y = _SHIFT.format(x=x)
    return f"xor({y}, ({y} << 5) & 4294967295)"


QUERIES = {
    "corpus_lines": corpus_lines,
    "line_limits": line_limits,
    "limited_lines": limited_lines,
    "eol_append": eol_append,
    "tokenizer_lines": tokenizer_lines,
    "read_all": read_all,
    "codepoint_freq": codepoint_freq,
    "distinct_codepoints": distinct_codepoints,
    "char_class_compat": _classes(T.char_class),
    "char_class_ascii": _classes(lambda c: T.char_class(c, "ascii")),
    "char_class_utf8len": _classes(lambda c: T.char_class(c, "utf8len")),
    "char_class_ranges": _classes(lambda c: T.char_class(c, "ranges", C.parse_ranges(RANGES))),
    "char_class_gold": _classes(T.gold_class),
    "class_transitions": class_transitions,
    "lossless_encode": lossless_encode,
    "lossless_decode": lossless_decode,
    "lossless_roundtrip": lossless_roundtrip,
    "detok_lines": detok_lines,
    "xorshift_stream": xorshift_stream,
    "utf8_normalize": utf8_normalize,
    "prefix_count": prefix_count,
    "bigram_count": bigram_count,
    "ngram_dump": ngram_dump,
}

ORACLE_SQL = {
    "utf8_normalize": "SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, '/'), (-2, '?x'), (-3, '?'), (-4, '??'))",
    "corpus_lines": f"WITH {LINES} SELECT * FROM lines",
    "line_limits": f"""WITH {LINES} SELECT count(*) AS n_lines, count(*) FILTER (strlen(line) > 4096) AS skipped_bytes, count(*) FILTER (strlen(line) <= 4096 AND length(line) > 2048) AS skipped_cp,
      count(*) FILTER (strlen(line) <= 4096 AND length(line) <= 2048) AS kept FROM lines""",
    "limited_lines": f"WITH {LINES} SELECT * FROM lines WHERE strlen(line) <= 4096 AND length(line) <= 2048",
    "eol_append": f"WITH {LINES} SELECT doc_id, line_no, line || '▃' AS line FROM lines",
    "tokenizer_lines": """SELECT d.doc_id, u.i - 1 AS line_no, rtrim(d.parts[u.i], chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(d.parts) + 1)) AS u(i)
      WHERE rtrim(d.parts[u.i], chr(13)) <> '' AND strlen(rtrim(d.parts[u.i], chr(13))) <= 16384""",
    "read_all": f"SELECT doc_id, md5({encode_sql('text')}) AS encoded_md5, length({encode_sql('text')}) AS n_cp, strlen({encode_sql('text')}) AS n_bytes FROM documents",
    "codepoint_freq": f"WITH {CHARS} SELECT unicode(ch)::BIGINT AS cp, ch, count(*) AS cnt FROM chars GROUP BY ch",
    "distinct_codepoints": f"WITH {CHARS} SELECT count(DISTINCT ch) AS n_distinct, count(*) AS n_total FROM chars",
    **{f"char_class_{m}": f"{_ALL_CHARS} SELECT ch, unicode(ch)::BIGINT AS cp, ({class_sql('unicode(ch)', m)})::BIGINT AS cls FROM seen" for m in ("compat", "ascii", "utf8len", "ranges")},
    "char_class_gold": f"{_ALL_CHARS} SELECT ch, unicode(ch)::BIGINT AS cp, ({gold_class_sql('unicode(ch)')})::BIGINT AS cls FROM seen",
    "class_transitions": f"""WITH {CHARS}, c AS (SELECT doc_id, line_no, i, {class_sql('unicode(ch)')} AS cls FROM chars)
      SELECT prev, cur, nxt, count(*) AS cnt FROM (SELECT coalesce(lag(cls) OVER w, 250)::BIGINT AS prev, cls::BIGINT AS cur, coalesce(lead(cls) OVER w, 251)::BIGINT AS nxt FROM c WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)) GROUP BY ALL""",
    "lossless_encode": f"WITH {TEXTS} SELECT doc_id, md5({encode_sql('text')}) AS encoded_md5, md5(translate(regexp_replace(text, '([▀▁▂▃▄])', '▀\\1', 'g'), ' ' || chr(9), '▁▂')) AS blanks_md5 FROM texts",
    "lossless_decode": f"WITH {TEXTS} SELECT doc_id, md5({decode_sql('text')}) AS decoded_md5, length({decode_sql('text')}) AS n_cp FROM texts",
    "lossless_roundtrip": f"WITH {TEXTS} SELECT doc_id, true AS same, md5(text) AS text_md5 FROM texts",
    "detok_lines": f"""WITH {LINES}, more AS (SELECT doc_id, line_no, line FROM lines{''.join(f' UNION ALL SELECT {-1 - k}, 0, {quoted(t)}' for k, t in enumerate(DETOK))}),
      plain AS (SELECT doc_id, line_no, {decode_sql("regexp_replace(line, '[ ' || chr(9) || ']+', '', 'g')")} AS t FROM more)
      SELECT doc_id, line_no, md5(CASE WHEN suffix(t, chr(10)) THEN t ELSE t || chr(10) END) AS text_md5 FROM plain""",
    "xorshift_stream": f"WITH a AS (SELECT doc_id, {_xs_sql('(doc_id + 1)')} AS s1 FROM documents), b AS (SELECT doc_id, s1, {_xs_sql('s1')} AS s2 FROM a) SELECT doc_id, s1, s2, (s2 >> 8) / 16777216.0::DOUBLE AS u2 FROM b",
    "prefix_count": f"WITH {_DOC_CHARS}, heads AS (SELECT ch || c1 || c2 || c3 AS h, count(*) AS n FROM led GROUP BY ALL), keys AS (SELECT unnest([{', '.join(repr(k) for k in KEYS)}]) AS key) SELECT key, sum(n)::BIGINT AS cnt FROM keys JOIN heads ON starts_with(h, key) GROUP BY key",
    "bigram_count": f"WITH {_DOC_CHARS} SELECT count(*) FILTER (ch || c1 = 'th') AS forward, count(*) FILTER (ch || c1 || c2 = 'the') AS forward_back FROM led",
    "ngram_dump": f"WITH {_DOC_CHARS} SELECT ch || c1 AS prefix, count(*) AS cnt FROM led GROUP BY ALL",
}
