"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from strandloom.llm.licences import DIGESTS, NOTICES, SPELLINGS, TEXTS
from strandloom.llm.quality import STOP_WORDS

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([g.i, g.i + 1, g.i + 2]) AS p FROM g JOIN r ON g.doc_id = r.doc_id AND g.g = r.g) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
f AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols / n_words <= 0.1 AND word_chars / n_words BETWEEN 2 AND 12
    AND n_dup_lines / len(lines) <= 0.4 AND stops / n_words >= 0.01 AS kept
FROM f
"""

_ITEM_WORDS = "regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g'), '[^ ]+')"

OP4 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, w[i:i + 12] AS g FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON dw.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, strlen(body) AS payload_bytes,
    list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
      ((instr('0123456789abcdef', substr(h, 1 + CAST((i + j) // 4 AS INTEGER), 1)) - 1) >> CAST(3 - (i + j) % 4 AS INTEGER) & 1) << CAST(4 - j AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
    row_number() OVER w AS nth, first_value(page_id) OVER w AS first
  FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM b
"""


def _canonical(text: str) -> str:
    sql = f"lower({text})"
    for variant, one in SPELLINGS:
        sql = f"replace({sql}, '{variant}', '{one}')"
    line = "(?m)^[ \\t\\x0b\\f/*#;-]*(?:copyright\\b|\\(c\\)|©|all rights reserved)[^\\r\\n]*$"
    return f"sha256(trim(regexp_replace(regexp_replace({sql}, '{line}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def _table(rows) -> str:
    quoted = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in rows)
    return f"SELECT {_canonical('text')} AS digest, min(name) AS name FROM (VALUES {quoted}) AS t(name, text) GROUP BY 1"


OP8 = f"""
WITH known AS (SELECT digest, min(name) AS name FROM ({_table(TEXTS)} UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{n}')" for n, d in DIGESTS)})) GROUP BY digest), notes AS ({_table(NOTICES)}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT l.doc_id, string_agg(DISTINCT notes.name, ',' ORDER BY notes.name) AS notices FROM l JOIN notes ON {_canonical('line')} = notes.digest WHERE regexp_matches(line, '(?i)licen[cs]e|released') GROUP BY l.doc_id),
w AS (SELECT doc_id, {_canonical('text')} AS digest FROM d)
SELECT w.doc_id, w.digest, known.name AS licence, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known ON w.digest = known.digest LEFT JOIN n ON w.doc_id = n.doc_id
"""

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

OP12 = f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (
    SELECT q.vec_id AS query_id, q.x AS asked, c.vec_id AS vec_id, list_inner_product(q.x, c.x) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND NOT (q.vec_id = c.vec_id AND q.x = c.x)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score
FROM pairs QUALIFY "rank" <= 20
"""


def _vector_codes(rounds: int = 4) -> str:
    """Lloyd's rounds one after another; sums of products of integers are exact in doubles here."""
    near = lambda r: f"""assigned{r} AS MATERIALIZED (
    SELECT p.row_no, p.part, arg_min(b.entry, (p.norm + b.norm - 2 * list_inner_product(p.x, b.x), b.entry)) AS entry,
        min(p.norm + b.norm - 2 * list_inner_product(p.x, b.x))::BIGINT AS squares
    FROM parts p JOIN book{r} b ON p.part = b.part GROUP BY p.row_no, p.part)"""  # noqa: E731
    moved = lambda r: f"""sums{r} AS (
    SELECT a.part, a.entry, c.i, sum(c.v) AS total, count(*) AS n
    FROM assigned{r} a JOIN components c ON a.row_no = c.row_no AND a.part = c.part GROUP BY a.part, a.entry, c.i),
means{r} AS (
    SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM sums{r} GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (
    SELECT part, entry, x, list_inner_product(x, x) AS norm
    FROM (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_no, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x
    FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (
    SELECT row_no, part, x, list_inner_product(x, x) AS norm
    FROM (SELECT row_no, j AS part, x[j * (len(x) // 4) + 1 : (j + 1) * (len(x) // 4)] AS x FROM kept, range(4) t(j))),
components AS MATERIALIZED (SELECT row_no, part, unnest(range(1, len(x) + 1)) AS i, unnest(x)::BIGINT AS v FROM parts),
book0 AS MATERIALIZED (SELECT part, row_no - 1 AS entry, x, norm FROM parts WHERE row_no <= 256),
{steps},
{near(rounds)},
told AS (
    SELECT k.vec_id, k.label, string_agg(printf('%02x', a.entry::INTEGER), '' ORDER BY a.part) AS code, sum(a.squares)::BIGINT AS error
    FROM kept k JOIN assigned{rounds} a ON k.row_no = a.row_no GROUP BY k.row_no, k.vec_id, k.label),
hashed AS (
    SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) AS codebooks_sha256
    FROM (SELECT part, entry, array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ',') AS s FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM told, hashed
"""


OP13 = _vector_codes()
