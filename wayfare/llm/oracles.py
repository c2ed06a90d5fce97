"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
-- Sources fill up in the order of cap / weight; the level is the first one that the next source does not fall below.
o AS (
  SELECT *, 2.0 * source_size / weight AS fills,
    coalesce(sum(2 * source_size) OVER w, 0) AS full_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
    1.5 * sum(source_size) OVER () AS dealt, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (dealt - full_before) / (weights - weight_before) AS level FROM o
  WHERE fills >= (dealt - full_before) / (weights - weight_before) ORDER BY fills, source LIMIT 1),
t AS (SELECT source, source_size, least(2.0 * source_size, weight * (SELECT level FROM level)) AS target FROM s),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

BLANK = r"[\x20\x09-\x0D]"


def normal(line: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_replace({line}, '{BLANK}+', ' ', 'g'))), '[0-9]', '0', 'g')"


QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM win),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, line, len(string_split(line, ' ')) AS words
  FROM (SELECT doc_id, source, unnest(lines) AS raw FROM d), LATERAL (SELECT {normal("raw")} AS line)),
frequent AS (
  SELECT source, line FROM (SELECT l.*, md5(d.text) AS whole FROM l JOIN d USING (doc_id)) GROUP BY source, line HAVING count(DISTINCT whole) >= 20),
lost AS (
  SELECT l.doc_id, sum(l.words)::BIGINT AS n FROM l JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, least(coalesce(lost.n, 0), len(w))::BIGINT AS removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR removed_words > 0.7 * n_words)) AS kept, removed_words
FROM v
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# CRC-32 of a short ASCII text, bit by bit.
ID_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::INT) & 1)::BIGINT)))),
    lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(first: str, name: str, levels: int) -> list[str]:
    """CTEs of a forest's levels (tree, i, h, m: nodes of the level) and of each node's siblings before and after it; a tree of one node stays as it is."""
    out = [first]
    for k in range(levels):
        run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(
            f"""{name}s{k} AS (SELECT tree, i, m, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})"""
        )
        out.append(
            f"""{name}{k + 1} AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS m FROM (
  SELECT tree, i // 16 AS i, CASE WHEN max(m) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY tree, i // 16))"""
        )
    return out


def _climb(name: str, levels: int, source: str, tree: str, start: str) -> list[str]:
    """CTEs that fold ``cur`` and gather the proof, level by level."""
    out = []
    for k in range(levels):
        out.append(
            f"""{name}c{k} AS (SELECT p.* EXCLUDE (cur, proof), CASE WHEN s.m = 1 THEN cur ELSE sha256(s.b || cur || s.a) END AS cur,
  CASE WHEN s.m = 1 THEN proof ELSE proof || s.b || s.a END AS proof
  FROM {source if k == 0 else f"{name}c{k - 1}"} p JOIN {name}s{k} s ON s.tree = p.{tree} AND s.i = p.{start} // {16**k})"""
        )
    return out


# Up to 16 ** 6 rows of a source and 16 ** 4 sources.
MERKLE = (
    "WITH "
    + ",\n".join(
        [
            f"""d AS (SELECT *, coalesce({ID_CRC} % 5 = 0, false) AS hit FROM documents)""",
            "sr AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
            f"""lf AS (SELECT doc_id, d.source, {_leaf("text").replace("source", "d.source")} AS leaf,
  CASE WHEN hit THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')").replace("source", "d.source")} END AS changed, tree
  FROM d JOIN sr ON d.source IS NOT DISTINCT FROM sr.source)""",
            "nl AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM lf)",
            *_levels("x0 AS (SELECT tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM nl)", "x", 6),
            *_levels("y0 AS (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS m FROM x6)", "y", 4),
            "p0 AS (SELECT *, coalesce(changed, leaf) AS cur, '' AS proof, 0 AS top FROM nl)",
            *_climb("x", 6, "p0", "tree", "i"),
            *_climb("y", 4, "xc5", "top", "tree"),
        ]
    )
    + """
SELECT doc_id, leaf, x6.h AS subroot, y4.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = y4.h AS verified
FROM yc3 JOIN x6 ON x6.tree = yc3.tree CROSS JOIN y4
"""
)

SPELLING = f"""
WITH RECURSIVE tb AS (
  SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) ORDER BY i) AS t
  FROM range(256) r(i)),
u AS (
  SELECT key, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, 'null') AS key, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT *, hex(encode(key || ':' || run)) AS x FROM u), tb),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
dl AS (SELECT word, n, p, substr(word, 1, p::INT) || substr(word, p::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)),
nr AS (
  SELECT a.word AS x, b.word AS y, b.n FROM dl a JOIN dl b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dl a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM dl a JOIN w b ON a.rest = b.word),
bs AS (SELECT x, count(*) AS n_near, arg_min(y, (-n, y)) AS y, max(n) AS yn FROM nr GROUP BY x),
f AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN yn >= 5 * n THEN y END AS form, CASE WHEN yn >= 5 * n THEN yn END AS form_n
  FROM w LEFT JOIN bs ON bs.x = w.word),
r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, k) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
