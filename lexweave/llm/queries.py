"""The operators' queries by name."""

from __future__ import annotations

from lexweave.llm import ctph, linededup, lmscore, matroska, mixing, packing, quality, repeats, simhash, tokencount

QUERIES = {
    "op1_matroska_packets": matroska.op1_matroska_packets,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_lm_scoring": lmscore.op3_lm_scoring,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_suffix_array_dedup": repeats.op8_suffix_array_dedup,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_document_fingerprints": ctph.op10_document_fingerprints,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LOWER = _UPPER.lower()

#: SQL over whole tables, where it can express an operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_suffix_array_dedup": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
  p AS (SELECT w.doc_id, u.i - 1 AS place, md5(array_to_string(w.w[u.i:u.i + 49], ' ')) AS g FROM w, unnest(range(1, len(w.w) - 48)) AS u(i)),
  f AS (SELECT g, min(doc_id) AS first, min((doc_id, place)) AS at FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
  r AS (SELECT p.doc_id, p.place, f.first, f.at[2] AS first_place, p.place - row_number() OVER (PARTITION BY p.doc_id, f.first ORDER BY p.place) AS island FROM p JOIN f USING (g) WHERE p.doc_id > f.first)
  SELECT doc_id, min(place)::INT AS start_word, (count(*) + 49)::INT AS words, first AS first_doc_id, arg_min(first_place, place)::INT AS first_start_word FROM r GROUP BY doc_id, first, island""",
    "op9_line_dedup": """WITH l AS (SELECT d.doc_id, u.i - 1 AS line_no, d.p[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL) d, unnest(range(1, len(d.p) + 1)) AS u(i) WHERE strlen(d.p[u.i]) >= 1),
  f AS (SELECT line, min((doc_id, line_no)) AS at, strlen(line) AS n FROM l GROUP BY line),
  pairs AS (SELECT a.line AS x, b.line AS y, a.at AS ax, b.at AS bx FROM f a JOIN (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM f) b ON a.n = b.m AND a.n >= 32 AND b.n >= 32 AND a.at < b.at),
  cand AS (SELECT * FROM pairs WHERE contains(y, substr(x, 1, length(x) // 3)) OR contains(y, substr(x, length(x) // 3 + 1, length(x) // 3)) OR contains(y, substr(x, 2 * (length(x) // 3) + 1))),
  near AS (SELECT bx, min((ax, levenshtein(x, y))) AS k FROM cand WHERE levenshtein(x, y) <= 2 GROUP BY bx),
  equal AS (SELECT l.doc_id, l.line_no, f.at[1] AS kept_doc_id, f.at[2] AS kept_line_no, 0 AS edits FROM l JOIN f USING (line) WHERE (l.doc_id, l.line_no) <> f.at)
  SELECT doc_id, line_no::INT AS line_no, kept_doc_id, kept_line_no::INT AS kept_line_no, edits::INT AS edits FROM equal UNION ALL SELECT bx[1], bx[2]::INT, k[1][1], k[1][2]::INT, k[2]::INT FROM near""",
}
