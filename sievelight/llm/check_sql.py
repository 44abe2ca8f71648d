"""DuckDB SQL that must give the rows of registered queries."""

from __future__ import annotations

# Unsigned crc32 of the decimal doc_id, bit by bit; null for null.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(
  list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
  lambda r, c: list_reduce(list_concat([xor(r, c)], list_transform(range(8), lambda i: 0::UBIGINT)),
                           lambda x, z: xor(x // 2, (x % 2) * 3988292384::UBIGINT))))"""

# Runs are stretches of equal windows of 6 words at one distance; of one stretch's distances the least is the period.
PERIODIC_RUNS = f"""
WITH hashed AS (
  SELECT row_number() OVER () AS r, doc_id, CAST({CRC32} AS BIGINT) AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), placed AS (
  SELECT *, len(w) AS n, h // 10 AS g,
         CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a
  FROM hashed
), tails AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), words AS (
  SELECT r, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM tails)
), windows AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
         || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), alike AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + 5 + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM alike)
  GROUP BY r, q, island
), runs AS (
  SELECT r, s, l, min(q) AS q FROM stretches WHERE l >= 12 AND l >= 2 * q GROUP BY r, s, l
), marks AS (
  SELECT r, i, sum(d) AS d FROM (
    SELECT r, s + q AS i, 1 AS d FROM runs UNION ALL SELECT r, s + l, -1 FROM runs
  ) GROUP BY r, i
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (
    SELECT words.r, words.i, word, coalesce(sum(d) OVER (PARTITION BY words.r ORDER BY words.i), 0) AS inside
    FROM words LEFT JOIN marks ON words.r = marks.r AND words.i = marks.i
  ) WHERE inside = 0 GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS best
  FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
       1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM tails LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

LINE_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, first IS NOT NULL AND doc_id <> first AS dropped FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


def _climb(leaves: str, name: str, levels: int) -> tuple[str, str]:
    """Tables of each level above ``leaves(tree, place, size, digest)``, and the last one's name."""
    parts, below = [], leaves
    for k in range(levels):
        parts.append(f"""
{name}_s{k} AS (
  SELECT tree, place, size, digest,
    CASE WHEN size > 1 THEN coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 8 ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lefts,
    CASE WHEN size > 1 THEN coalesce(string_agg(digest, '') OVER (PARTITION BY tree, place // 8 ORDER BY place
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rights
  FROM {below}
), {name}_n{k} AS (
  SELECT tree, place // 8 AS place, (max(size) + 7) // 8 AS size,
    CASE WHEN max(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE max(digest) END AS digest
  FROM {below} GROUP BY tree, place // 8
)""")
        below = f"{name}_n{k}"
    return ",".join(parts), below


def merkle(levels: int = 7, top: int = 3) -> str:
    """For at most 8 ** levels documents of a language and 8 ** top languages."""

    def leaf(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    inner, last = _climb("leaves", "d", levels)
    outer, root = _climb("tops", "t", top)
    steps, fold, proof = "", "claim", []
    for k in range(levels + top):
        s = f"d_s{k}" if k < levels else f"t_s{k - levels}"
        here = f"leaves.place // {8**k}" if k < levels else f"tops.place // {8 ** (k - levels)}"
        tree = f"{s}.tree = leaves.tree AND " if k < levels else ""
        if k == levels:
            steps += "\nJOIN tops ON tops.lang_tree = leaves.tree"
        steps += f"\nJOIN {s} ON {tree}{s}.place = {here}"
        proof.append(f"coalesce({s}.lefts || {s}.rights, '')")
        fold = f"CASE WHEN {s}.lefts IS NULL THEN {fold} ELSE sha256({s}.lefts || {fold} || {s}.rights) END"
    return f"""
WITH rows AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {leaf("text")} AS digest,
         CASE WHEN {CRC32} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claim
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, claim) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS size
  FROM rows
),{inner}, tops AS (
  SELECT '' AS tree, tree AS lang_tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size
  FROM {last}
),{outer}, joined AS (
  SELECT doc_id, leaves.digest AS leaf, tops.digest AS subroot, {root}.digest AS root,
         sha256({" || ".join(proof)}) AS proof_sha256, {fold} AS folded_root
  FROM leaves {steps}
  CROSS JOIN {root}
)
SELECT *, folded_root = root AS verified FROM joined
"""
