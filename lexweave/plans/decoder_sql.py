"""DuckDB SQL of the decoders and the training steps over whole tables: a fold over each line's lattice, from place to place.

A line is a list of its places, each a list of the scores of the spans of 1 to 4 characters that end there. list_reduce carries the
scores of the places so far, the last one first; a second fold walks back from the end.
"""

from __future__ import annotations

import re

from lexweave.plans.segment_queries import _COSTS, _EMIT, _GOLD, _MSTEP, _PRESET_SQL, _RUN, _VOCAB, TARGET, UNK_BASE, UNK_PER_CP, _normalized, _pruned, _q
from lexweave.plans.text_queries import CHARS, LINES, class_sql

N = -(1 << 50)
FIXED = 1 << 24
_KS = (1, 2, 3, 4)
_W = "WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)"


def _word(k: int) -> str:
    return " || ".join([f"lag(ch, {j}) OVER w" for j in range(k - 1, 0, -1)] + ["ch"])


_ENDED = ", ended AS (SELECT doc_id, line_no, i, " + ", ".join(f"{_word(k)} AS w{k}" for k in _KS) + f" FROM chars {_W})"
_PIECES = f", q AS (SELECT piece, piece_id, logp, {_q('logp')} AS logp_q FROM vocab)"
_JOINED = " ".join(f"LEFT JOIN q q{k} ON q{k}.piece = e.w{k}" for k in _KS)


def _seg(k: int) -> str:
    if k == 1:
        return "emit1 - 154"
    return f"lag(emit1, {k - 1}) OVER w + r - lag(r, {k - 1}) OVER w + {51 * (k - 2) - 102}"


# the joint model's scores of the spans that end at each place
_LATTICE = (
    _RUN[len(CHARS) :]
    + _PIECES
    + _ENDED
    + ", seg AS (SELECT doc_id, line_no, i, "
    + ", ".join(f"{_seg(k)} AS g{k}" for k in _KS)
    + f" FROM run {_W}), scored AS (SELECT e.doc_id, e.line_no, e.i, ["
    + ", ".join(f"CASE WHEN e.w{k} IS NULL THEN {N} ELSE s.g{k} + coalesce(q{k}.logp_q, greatest(-32768, {UNK_BASE + k * UNK_PER_CP})) END" for k in _KS)
    + f"]::BIGINT[] AS y FROM ended e JOIN seg s ON s.doc_id = e.doc_id AND s.line_no = e.line_no AND s.i = e.i {_JOINED}), "
    + "lists AS (SELECT doc_id, line_no, list(y ORDER BY i) AS x, count(*) AS n FROM scored GROUP BY ALL)"
)
_JOINT = _VOCAB + _LATTICE
# the same of the lines without their blanks; the vocabulary is that of the lines as they are
_PLAIN = f"""{re.sub(r'\b(lines|chars)\b', r'whole_\1', _VOCAB)}, lines AS (SELECT doc_id, line_no, translate(line, ' ' || chr(9), '') AS line FROM whole_lines), {CHARS[len(LINES) + 2 :]}{_LATTICE}"""
# the unigram model's, in fixed point
_UNIGRAM = (
    _VOCAB
    + _PIECES
    + _ENDED
    + ", scored AS (SELECT e.doc_id, e.line_no, e.i, ["
    + ", ".join(f"coalesce(round_even(q{k}.logp * {FIXED}, 0)::BIGINT, {N})" for k in _KS)
    + f"]::BIGINT[] AS y FROM ended e {_JOINED}), lists AS (SELECT doc_id, line_no, list(y ORDER BY i) AS x, count(*) AS n FROM scored GROUP BY ALL)"
)


def _best(start: int, order: tuple[int, ...]) -> str:
    """lens: the length of the best path's last span at each place, the first of `order` where some are equal; cuts: its boundaries."""
    top = "greatest(" + ", ".join(f"a[{k}] + y[{k}]" for k in _KS) + ")"
    back = " ".join(f"WHEN b[n - p + 1 + {k}] + x[p][{k}] = b[n - p + 1] THEN {k}" for k in order)
    return f""", best AS (SELECT *, list_reduce(x, lambda a, y: list_prepend({top}, a), [{start}, {N}, {N}, {N}]::BIGINT[]) AS b FROM lists),
      lens AS (SELECT *, list_transform(range(n, 0, -1), lambda p: [p, CASE {back} END]) AS back FROM best),
      cuts AS (SELECT doc_id, line_no, n, b[1] AS score, list_reduce(back, lambda a, y: CASE WHEN y[1] = a[1] THEN list_prepend(a[1] - y[2], a) ELSE a END, [n]::BIGINT[]) AS cut FROM lens)"""


def _tokens(source: str, *more: str) -> str:
    return f"""SELECT c.doc_id, c.line_no, (len(c.cut) - 1)::BIGINT AS n_tokens, md5(array_to_string(list_transform(range(1, len(c.cut)), lambda j: substring(l.line, c.cut[j] + 1, c.cut[j + 1] - c.cut[j])), chr(10))) AS tokens_md5{''.join(', ' + m for m in more)}
      FROM {source} c JOIN lines l USING (doc_id, line_no)"""


# the four best at a place: score * 16 + 15 - candidate, so that of equal scores the first candidate is greater
_FOUR = "list_slice(list_reverse_sort([" + ", ".join(f"((a[{4 * (k - 1) + r}] >> 4) + y[{k}]) * 16 + {15 - (4 * (k - 1) + r - 1)}" for k in _KS for r in _KS) + "]), 1, 4)"
_TAKEN = "(15 - (y[1 + a[2]] & 15))"
_NBEST = f"""{_JOINT}, kept AS (SELECT *, list_reduce(x, lambda a, y: list_concat({_FOUR}, a), [128 * 16, {', '.join([str(N * 16 // 4)] * 15)}]::BIGINT[]) AS b FROM lists),
  back AS (SELECT doc_id, line_no, n, b, list_transform(range(n, 0, -1), lambda p: [p, b[4 * (n - p) + 1], b[4 * (n - p) + 2], b[4 * (n - p) + 3], b[4 * (n - p) + 4]]) AS back FROM kept),
  four AS (SELECT *, unnest([1, 2, 3, 4]) AS r FROM back),
  cuts AS (SELECT doc_id, line_no, (r - 1)::INT AS rank, b[r] >> 4 AS score, list_reduce(back, lambda a, y: CASE WHEN y[1] = a[1]
    THEN list_concat([a[1] - 1 - {_TAKEN} // 4, 1 + {_TAKEN} % 4, a[1] - 1 - {_TAKEN} // 4], list_slice(a, 3, len(a))) ELSE a END, [n, r, n]::BIGINT[]) AS found FROM four WHERE b[r] >> 4 > {N // 8}),
  paths AS (SELECT doc_id, line_no, rank, score, list_slice(found, 3, len(found)) AS cut FROM cuts)"""


def next_state(x: str) -> str:
    x = f"xor({x}, ({x} << 13) & 4294967295)"
    x = f"xor({x}, {x} >> 17)"
    return f"xor({x}, ({x} << 5) & 4294967295)"


def seed_sql(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % 4294967295 + 1)"


def _lse(*terms: str) -> str:
    m = f"greatest({', '.join(terms)})"
    return f"({m} + ln({' + '.join(f'exp({t} - {m})' for t in terms)}))"


_MINUS = "-1e300"
_STATE = next_state("a[2]::BIGINT")
_DRAWN = f"CASE WHEN (({_STATE}) >> 8) / 16777216.0 * y[5] <= y[2] THEN 1 WHEN (({_STATE}) >> 8) / 16777216.0 * y[5] <= y[3] THEN 2 WHEN (({_STATE}) >> 8) / 16777216.0 * y[5] <= y[4] THEN 3 ELSE 4 END"
_FFBS = f"""{_JOINT}, sums AS (SELECT *, list_reduce(list_transform(x, lambda y: list_transform(y, lambda v: CASE WHEN v < {N // 2} THEN {_MINUS} ELSE v / 256.0 END)::DOUBLE[]), lambda a, y: list_prepend({_lse(*(f'(a[{k}] + y[{k}])' for k in _KS))}, a),
    [0.5, {_MINUS}, {_MINUS}, {_MINUS}]::DOUBLE[]) AS b FROM lists),
  logs AS (SELECT *, list_transform(range(n, 0, -1), lambda p: [p{''.join(f', CASE WHEN x[p][{k}] < {N // 2} THEN {_MINUS} ELSE b[n - p + 1 + {k}] + x[p][{k}] / 256.0 END' for k in _KS)}]::DOUBLE[]) AS lw FROM sums),
  weights AS (SELECT doc_id, line_no, n, x, list_transform(lw, lambda y: [y[1]{''.join(f', exp(y[{k + 1}] - greatest(y[2], y[3], y[4], y[5]))' for k in _KS)}]) AS lw FROM logs),
  totals AS (SELECT doc_id, line_no, n, x, list_transform(lw, lambda y: [y[1], y[2], y[2] + y[3], y[2] + y[3] + y[4], y[2] + y[3] + y[4] + y[5]]) AS back FROM weights),
  reps AS (SELECT *, unnest([1, 2]) AS rep FROM totals),
  walked AS (SELECT doc_id, line_no, rep, n, x, list_reduce(back, lambda a, y: CASE WHEN y[1] = a[1] THEN list_concat([a[1] - {_DRAWN}, ({_STATE})::DOUBLE, a[1] - {_DRAWN}], list_slice(a, 3, len(a))) ELSE a END,
    [n, {seed_sql('doc_id * 1000003', 'line_no * 7919', 'rep * 104729')}, n]::DOUBLE[]) AS found FROM reps),
  paths AS (SELECT doc_id, line_no, rep, x, list_slice(found, 3, len(found))::BIGINT[] AS cut FROM walked),
  drawn AS (SELECT doc_id, line_no, rep, cut, (128 + list_sum(list_transform(range(2, len(cut) + 1), lambda j: x[cut[j]][cut[j] - cut[j - 1]])))::BIGINT AS score FROM paths)"""

# expected uses of pieces: sums of the paths to each place and from each
def _em(logp: str) -> str:
    return f"""{_VOCAB}{_PIECES}{_ENDED}, ids AS (SELECT e.doc_id, e.line_no, e.i, {', '.join(f'q{k}.piece_id AS p{k}, CASE WHEN q{k}.piece_id IS NULL THEN {_MINUS} ELSE {logp.format(k=k)} END AS l{k}' for k in _KS)} FROM ended e {_JOINED}),
  begun AS (SELECT *, {', '.join(f'lead(l{k}, {k}) OVER w AS f{k}' for k in _KS)} FROM ids {_W}),
  lists AS (SELECT doc_id, line_no, count(*) AS n, list([l1, l2, l3, l4]::DOUBLE[] ORDER BY i) AS x, list([{', '.join(f'coalesce(f{k}, {_MINUS})' for k in _KS)}]::DOUBLE[] ORDER BY i DESC) AS z FROM begun GROUP BY doc_id, line_no),
  sums AS (SELECT doc_id, line_no, n, list_reverse(list_reduce(x, lambda a, y: list_prepend({_lse(*(f'(a[{k}] + y[{k}])' for k in _KS))}, a), [0, {_MINUS}, {_MINUS}, {_MINUS}]::DOUBLE[])) AS alpha,
    list_reduce(list_slice(z, 2, n), lambda a, y: list_prepend({_lse(*(f'(a[{k}] + y[{k}])' for k in _KS))}, a), [0, {_MINUS}, {_MINUS}, {_MINUS}]::DOUBLE[]) AS beta FROM lists),
  places AS (SELECT doc_id, line_no, alpha[len(alpha)] AS z, unnest(range(1, n + 1)) AS i, unnest(list_slice(alpha, 4, n + 3)) AS a_before, unnest(list_slice(beta, 1, n)) AS b FROM sums),
  around AS (SELECT doc_id, line_no, i, z, b, a_before AS a1, {', '.join(f'lag(a_before, {k - 1}) OVER w AS a{k}' for k in _KS[1:])} FROM places {_W}),
  uses AS ({' UNION ALL '.join(f'SELECT d.p{k} AS piece_id, exp(r.a{k} + d.l{k} + r.b - r.z) AS u FROM around r JOIN ids d ON d.doc_id = r.doc_id AND d.line_no = r.line_no AND d.i = r.i WHERE d.p{k} IS NOT NULL' for k in _KS)}),
  total AS (SELECT DISTINCT doc_id, line_no, z FROM places)"""


_EM = f"""{_em('q{k}.logp')}
  SELECT piece_id, round(sum(u), 2) AS cnt FROM uses GROUP BY piece_id UNION ALL SELECT -1, round(sum(z), 2) FROM total UNION ALL SELECT -2, count(*)::DOUBLE FROM total UNION ALL SELECT -3, round(sum(u), 2) FROM uses UNION ALL SELECT -4, 0.0"""

_ITERATION = f"""{_em('-ln((SELECT count(*) FROM vocab)::DOUBLE)')}, used AS (SELECT piece_id, sum(u) AS cnt FROM uses GROUP BY piece_id),
  expected AS (SELECT v.piece_id, v.piece, v.len_cp, v.mandatory, coalesce(u.cnt, 0.0::DOUBLE) AS cnt, 0.0::DOUBLE AS logp FROM vocab v LEFT JOIN used u USING (piece_id)),
  smoothed AS (SELECT * REPLACE (ln(greatest((cnt + 0.1) / (SELECT sum(cnt + 0.1::DOUBLE) FROM expected), 1e-12)) AS logp) FROM expected), {_normalized('smoothed', 'fitted')}{_COSTS[len(_MSTEP):]}"""
_PRUNED = _pruned(0.0, f"r <= {TARGET} - (SELECT count(*) FROM scored WHERE always)")[len("WITH " + _COSTS) :].replace("round(logp, 7)", "round(logp, 5)")

_T = {(0, 0): 0.2, (0, 1): -0.4, (1, 0): 0.0, (1, 1): -0.6}


def _weights(y: int) -> str:
    one = "coalesce((SELECT w FROM given g WHERE g.tid = {t} AND g.label = {y} AND g.v1 = x.{a}), 0)"
    return " + ".join(one.format(t=t, y=y, a=a) for t, a in ((0, "c"), (1, "p"), (2, "n"))) + "::DOUBLE"


_CRF = f"""{_GOLD}, {_PRESET_SQL}, each AS (SELECT l.doc_id, l.line_no, u.i, l.c[u.i] AS ch, l.yy[u.i]::INT AS y FROM (SELECT doc_id, line_no, string_split(s, '') AS c, string_split(y, '') AS yy FROM labelled WHERE length(s) <= 2048) l, unnest(range(1, len(l.c) + 1)) AS u(i)),
  marked AS (SELECT doc_id, line_no, i, y, ({class_sql('unicode(ch)')})::BIGINT AS c FROM each),
  ctx AS (SELECT doc_id, line_no, i, y, c, coalesce(lag(c) OVER w, 250) AS p, coalesce(lead(c) OVER w, 251) AS n FROM marked {_W}),
  emits AS (SELECT x.*, {_weights(0)} AS e0, {_weights(1)} AS e1 FROM (SELECT DISTINCT p, c, n FROM ctx) x),
  full_ AS (SELECT * FROM ctx JOIN emits USING (p, c, n)),
  lists AS (SELECT doc_id, line_no, count(*) AS m, list([e0, e1]::DOUBLE[] ORDER BY i) AS x, list([e0, e1]::DOUBLE[] ORDER BY i DESC) AS z FROM full_ GROUP BY ALL),
  sums AS (SELECT doc_id, line_no, m, list_reduce(list_slice(x, 2, m), lambda a, y: list_concat([y[1] + {_lse('(a[1] + 0.2)', 'a[2]')}, y[2] + {_lse('(a[1] - 0.4)', '(a[2] - 0.6)')}], a), [{_MINUS}, x[1][2]]::DOUBLE[]) AS f,
    list_reduce(list_slice(z, 1, m - 1), lambda b, y: list_concat([{_lse('(0.2 + y[1] + b[1])', '(y[2] + b[2] - 0.4)')}, {_lse('(y[1] + b[1])', '(y[2] + b[2] - 0.6)')}], b), [-0.4, -0.6]::DOUBLE[]) AS b FROM lists),
  places AS (SELECT doc_id, line_no, m, {_lse('(f[1] - 0.4)', '(f[2] - 0.6)')} AS logz, unnest(range(1, m + 1)) AS i, unnest(list_transform(range(1, m + 1), lambda j: f[2 * (m - j) + 1])) AS a0, unnest(list_transform(range(1, m + 1), lambda j: f[2 * (m - j) + 2])) AS a1,
    unnest(list_transform(range(1, m + 1), lambda j: b[2 * j - 1])) AS b0, unnest(list_transform(range(1, m + 1), lambda j: b[2 * j])) AS b1 FROM sums),
  pairs AS (SELECT f.*, q.m, q.logz, q.a0, q.a1, q.b0, q.b1, lag(q.a0) OVER w AS o0, lag(q.a1) OVER w AS o1, lag(f.y) OVER w AS oy FROM full_ f JOIN places q USING (doc_id, line_no, i) WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
  per AS (SELECT p, c, n, sum((y = 0)::INT - exp(a0 + b0 - logz)) AS g0, sum((y = 1)::INT - exp(a1 + b1 - logz)) AS g1 FROM pairs GROUP BY ALL),
  lab2 AS (SELECT p, c, n, 0 AS y, g0 AS g FROM per UNION ALL SELECT p, c, n, 1, g1 FROM per),
  feats AS (SELECT y * 65536 + c * 256 AS key, g FROM lab2 UNION ALL SELECT 16777216 + y * 65536 + p * 256, g FROM lab2 UNION ALL SELECT 2 * 16777216 + y * 65536 + n * 256, g FROM lab2
    UNION ALL SELECT 3 * 16777216 + y * 65536 + p * 256 + c, g FROM lab2 UNION ALL SELECT 4 * 16777216 + y * 65536 + c * 256 + n, g FROM lab2),
  trans AS ({' UNION ALL '.join(f"SELECT {-1 - 2 * j - k} AS key, sum((oy = {j} AND y = {k})::INT - exp(o{j} + ({_T[j, k]}) + e{k} + b{k} - logz)) FILTER (oy IS NOT NULL)" + (f" + sum((y = {j})::INT - exp(a{j} + ({_T[j, k]}) - logz)) FILTER (i = m)" if k else '') + ' AS g FROM pairs' for j in (0, 1) for k in (0, 1))}),
  ll AS (SELECT sum(CASE WHEN y = 0 THEN e0 ELSE e1 END) + sum(CASE {' '.join(f'WHEN oy = {j} AND y = {k} THEN {_T[j, k]}' for j, k in _T)} ELSE 0 END) + sum(CASE WHEN i < m THEN 0 WHEN y = 0 THEN -0.4 ELSE -0.6 END) - sum(logz) FILTER (i = m) AS v, count(*) AS n FROM pairs)"""
_GRADIENT = f"""{_CRF}
  SELECT p.key, round(coalesce(f.g, 0), 4) AS gradient FROM preset p LEFT JOIN (SELECT key, sum(g) AS g FROM feats GROUP BY key) f USING (key) UNION ALL SELECT key, round(g, 4) FROM trans UNION ALL SELECT -5, round(v, 3) FROM ll UNION ALL SELECT -6, n::DOUBLE FROM ll"""

_WORDS = f"{_UNIGRAM}{_best(0, (4, 3, 2, 1))}"
ORACLE_SQL = {
    "joint_viterbi": f"WITH {_JOINT}{_best(128, _KS)} {_tokens('cuts', 'c.score')}",
    "unigram_viterbi": f"WITH {_WORDS} {_tokens('cuts', f'round(c.score / {FIXED}.0::DOUBLE, 6) AS logp')}",
    "nbest_tokens": f"WITH {_NBEST} {_tokens('paths', 'c.rank', 'c.score')}",
    "sample_from_nbest": f"WITH {_NBEST}, picked AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line_no) AS k FROM paths) WHERE rank = {next_state(seed_sql('doc_id * 1000003', 'line_no * 7919'))} % k) {_tokens('picked', 'c.rank', 'c.score')}",
    "ffbs_sample": f"WITH {_FFBS} {_tokens('drawn', 'c.rep', 'c.score')}",
    "model_f1": f"""WITH {_PLAIN}{_best(128, _KS)}, {_GOLD[len(LINES) + 2 :].replace('FROM lines)', 'FROM whole_lines)')}, sides AS (SELECT list_slice(c.cut, 1, len(c.cut) - 1) AS f, string_split(l.y, '') AS y FROM cuts c JOIN labelled l USING (doc_id, line_no)),
      starts AS (SELECT f, list_filter(range(0, len(y)), lambda i: y[i + 1] = '1') AS g FROM sides), s AS (SELECT sum(len(f))::BIGINT AS found, sum(len(g))::BIGINT AS gold, sum(len(list_intersect(f, g)))::BIGINT AS hits FROM starts),
      r AS (SELECT *, hits / found::DOUBLE AS p, hits / gold::DOUBLE AS r FROM s) SELECT found, gold, hits, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM r""",
    "pseudo_labels": f"WITH {_WORDS} SELECT doc_id, line_no, n, md5(array_to_string(list_transform(range(2, len(cut) + 1), lambda j: '1' || repeat('0', cut[j] - cut[j - 1] - 1)), '')) AS y_md5 FROM cuts",
    "em_expected_counts": f"WITH {_EM}",
    "em_iteration": f"WITH {_ITERATION}{_PRUNED}",
    "token_lines": f"WITH {_JOINT}{_best(128, _KS)} SELECT md5(array_to_string(list_transform(range(1, len(c.cut)), lambda j: substring(l.line, c.cut[j] + 1, c.cut[j + 1] - c.cut[j])), ' ')) AS value_md5 FROM cuts c JOIN lines l USING (doc_id, line_no)",
    "crf_gradient_step": f"WITH {_GRADIENT}",
    "crf_sgd_step": f"""WITH {_CRF}, w0 AS (SELECT p.key, coalesce(g.w, 0)::DOUBLE AS w FROM preset p LEFT JOIN given g ON p.tid = g.tid AND p.label = g.label AND p.v1 = g.v1 AND p.tid < 3),
      moved AS (SELECT w0.key, w0.w, coalesce(f.g, 0) AS g FROM w0 LEFT JOIN (SELECT key, sum(g) AS g FROM feats GROUP BY key) f USING (key) UNION ALL SELECT t.key, x.w::DOUBLE, t.g FROM trans t JOIN (VALUES (-1, 0.2), (-2, -0.4), (-3, 0.0), (-4, -0.6)) x(key, w) USING (key))
      SELECT key::BIGINT AS key, round(w + 0.05 * (g - 1e-4 * w) / (SELECT n FROM ll), 7) AS weight FROM moved""",
}
assert _EMIT.startswith(CHARS) and _VOCAB.startswith(CHARS)
