"""DuckDB twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from chronotile.llm.lm_score import BACKOFF

#: Stupid backoff of order 2, every count without the document's own share; logs are summed as whole billionths.
LM_SCORE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words
  FROM documents),
t AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS c FROM t),
total AS (SELECT count(*) AS n FROM t),
one_own AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
one AS (SELECT w, sum(n) AS n FROM one_own GROUP BY w),
two_own AS (SELECT r, c, w, count(*) AS n FROM g WHERE i > 0 GROUP BY r, c, w),
two AS (SELECT c, w, sum(n) AS n FROM two_own GROUP BY c, w),
one_else AS (SELECT o.r, o.w, a.n - o.n AS n FROM one_own o JOIN one a USING (w)),
two_else AS (SELECT o.r, o.c, o.w, a.n - o.n AS n FROM two_own o JOIN two a USING (c, w)),
s AS (
  SELECT g.r, g.i, coalesce(b.n, 0) > 0 AS seen, CASE
    WHEN coalesce(b.n, 0) > 0 THEN b.n::DOUBLE / greatest(x.n, 1)::DOUBLE
    ELSE (CASE WHEN g.i > 0 THEN {BACKOFF}::DOUBLE ELSE 1::DOUBLE END)
      * ((CASE WHEN u.n > 0 THEN u.n::DOUBLE ELSE {BACKOFF}::DOUBLE END) / greatest(total.n - len(d.words), 1)::DOUBLE) END AS p
  FROM g JOIN d ON d.r = g.r CROSS JOIN total
  JOIN one_else u ON u.r = g.r AND u.w = g.w
  LEFT JOIN one_else x ON x.r = g.r AND x.w = g.c
  LEFT JOIN two_else b ON b.r = g.r AND b.c = g.c AND b.w = g.w),
per AS (
  SELECT r, sum(CAST(round_even(ln(p) * 1e9, 0) AS BIGINT)) AS score, count(*) FILTER (WHERE i > 0 AND NOT seen) AS n_backoff
  FROM s GROUP BY r)
SELECT d.doc_id::BIGINT AS doc_id, len(d.words)::BIGINT AS n_words, floor(coalesce(per.score, 0)::DOUBLE / 1000) / 1e6 AS log_score,
  coalesce(per.n_backoff, 0)::BIGINT AS n_backoff
FROM d LEFT JOIN per USING (r)"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 of the decimal id, bit by bit; null for a null id.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _leaf(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


#: Trees of arity 16: levels by recursion, then each leaf's steps, its proof and the fold of the tampered leaf.
MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, doc_id IS NOT NULL AND {_CRC} % 5 = 0 AS hit FROM documents),
l AS (
  SELECT r, doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf, {_leaf('changed')} AS other
  FROM (SELECT *, CASE WHEN hit THEN translate(text, {_AZ}) ELSE text END AS changed FROM d)),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 16),
subs AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (
  SELECT p.r, u.lvl AS k, u.pos AS place, u.h, p.pos // (1::BIGINT << (4 * u.lvl)) AS mine
  FROM p JOIN up u ON u.tree = p.tree AND u.n > 1 AND u.pos // 16 = p.pos // (1::BIGINT << (4 * u.lvl + 4))
  UNION ALL
  SELECT p.r, 100 + t.lvl, t.pos, t.h, s.pos // (1::BIGINT << (4 * t.lvl))
  FROM p JOIN subs s USING (tree) JOIN top t ON t.n > 1 AND t.pos // 16 = s.pos // (1::BIGINT << (4 * t.lvl + 4))),
proof AS (SELECT r, string_agg(h, '' ORDER BY k, place) FILTER (place <> mine) AS others FROM steps GROUP BY r),
sides AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS i, before, after FROM (
    SELECT r, k, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < mine), '') AS before,
      coalesce(string_agg(h, '' ORDER BY place) FILTER (place > mine), '') AS after FROM steps GROUP BY r, k)),
folds AS (
  SELECT r, 0::BIGINT AS i, other AS h FROM p
  UNION ALL
  SELECT f.r, s.i, sha256(s.before || f.h || s.after) FROM folds f JOIN sides s ON s.r = f.r AND s.i = f.i + 1),
folded AS (SELECT r, arg_max(h, i) AS h FROM folds GROUP BY r),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id::BIGINT AS doc_id, p.leaf, subs.subroot, root.h AS root, sha256(coalesce(proof.others, '')) AS proof_sha256, folded.h AS folded_root,
  folded.h = root.h AS verified
FROM p JOIN subs USING (tree) JOIN folded USING (r) LEFT JOIN proof USING (r) CROSS JOIN root"""

ORACLE: dict[str, str] = {"op1_lm_score": LM_SCORE, "op11_merkle": MERKLE}
