"""DuckDB SQL for the numbered queries that SQL can express."""

from quoin.llm.quality import BOILERPLATE_TEXT, NOISY_TEXT

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

BOILERPLATE_SQL = BOILERPLATE_TEXT.replace("'", "''")
QUALITY_PARTS = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
one AS (SELECT doc_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w),
tri AS (SELECT doc_id, i, w1, lead(w1) OVER l AS w2, lead(w1, 2) OVER l AS w3 FROM one WINDOW l AS (PARTITION BY doc_id ORDER BY i)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1
),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM w),
lw AS (SELECT doc_id, text AS line, k, {WORDS} AS words FROM lines),
judged AS (
  SELECT doc_id, k, length(array_to_string(words, '')) AS chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again,
    3 * len(list_filter(words, lambda x: regexp_matches(x, '{NOISY_TEXT}'))) >= len(words)
    OR (len(words) >= 25 AND NOT regexp_matches(line, '[.,;:!?]|…|。|[\x{{FF00}}-\x{{FF3F}}]'))
    OR (len(list_filter(words, lambda x: x IN ('|', '>', '·', '»'))) >= 3 AND 6 * len(list_filter(words, lambda x: x IN ('|', '>', '·', '»'))) >= len(words))
    OR (len(words) <= 25 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BOILERPLATE_SQL}')) AS bad
  FROM lw WHERE len(words) > 0
),
loss AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE again OR bad), 0) AS lost FROM judged GROUP BY doc_id
),
base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN loss USING (doc_id)
),
verdict AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= word_chars AS kept
  FROM base
)
"""
QUALITY = f"{QUALITY_PARTS} SELECT * FROM verdict"

#: The documents that pass, their texts without the lines that fail.
CLEANED = f"""{QUALITY_PARTS},
cleaned AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM lw LEFT JOIN judged USING (doc_id, k) WHERE NOT coalesce(again OR bad, false) GROUP BY doc_id)
SELECT d.doc_id, cleaned.text, d.source FROM documents d JOIN verdict USING (doc_id) JOIN cleaned USING (doc_id) WHERE verdict.kept
"""

FOLDED = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = rf"""
WITH item AS (SELECT item_id, {FOLDED} AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS k, array_to_string(words[i:i+12], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM item WHERE len(words) > 0)
),
doc AS (SELECT doc_id, {FOLDED} AS words FROM documents),
spot AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM doc),
run AS (SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM spot),
hit AS (
  SELECT doc_id, i, a.k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(ws[1:k], ' ') AS w FROM run, (SELECT DISTINCT k FROM win) WHERE i + k - 1 <= n) a
  JOIN win USING (k, w)
),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

MIX_PARTS = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
e AS (SELECT *, greatest(1, floor(sqrt(size)))::BIGINT AS pull FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * pull)::BIGINT AS pulled,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM e GROUP BY source
),
t AS (
  SELECT *, 3 * source_size AS full_size,
    (sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    (sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM s WINDOW l AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)
),
u AS (SELECT *, (SELECT rest::DOUBLE / open FROM t WHERE full_size * open > rest * weight ORDER BY full_size::DOUBLE / weight, source NULLS LAST LIMIT 1) AS level FROM t),
v AS (SELECT source, source_size, pulled, CASE WHEN level IS NULL THEN full_size::DOUBLE ELSE least(full_size::DOUBLE, level * weight) END AS target FROM u),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM v),
y AS (SELECT *, target - whole * source_size AS left_over FROM x),
p AS (
  SELECT e.doc_id, e.size, y.source, source_size, target, whole, left_over,
    (('0x' || substr(md5('mix:' || coalesce(e.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS r,
    least(0.999999::DOUBLE, greatest(1e-12::DOUBLE, left_over * pull / greatest(pulled, 1))) AS pr
  FROM e JOIN y ON e.source IS NOT DISTINCT FROM y.source
),
q AS (SELECT *, (r / (1 - r)) * ((1 - pr) / pr) AS q FROM p),
z AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM q),
m AS (SELECT doc_id, size, source_size, target, (whole + CASE WHEN left_over > 0 AND 2 * earlier + size <= 2 * left_over THEN 1 ELSE 0 END)::BIGINT AS copies FROM z)
"""
MIX = f"{MIX_PARTS} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM m"

REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
spot AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
run AS (SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS ws FROM spot),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws, ' ')) AS c FROM run WHERE i + 34 <= n) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM often),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM spot ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

FOLDED_WORDS = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {FOLDED_WORDS} AS words FROM documents),
spot AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
run AS (SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ws FROM spot),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws, ' ') AS s FROM run WHERE i + 4 <= n OR (n < 5 AND i = 1)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""

#: CRC-32 by its table, folded over the bytes of a text
SHARDS = r"""
WITH RECURSIVE step AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
s AS (
  SELECT doc_id, len(bytes) + 1 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS grp,
    CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(bytes, lambda c, x: xor(c >> 8, list_extract(tab, xor(c, x) % 256 + 1)), 4294967295::BIGINT), 4294967295) END AS text_crc32
  FROM h, crc_table
),
line AS (
  SELECT *, (sum(size) OVER w)::BIGINT - size AS before_size, row_number() OVER w AS nth, (sum(size) OVER ())::BIGINT AS total
  FROM s WINDOW w AS (ORDER BY grp, text_crc32, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
),
ends AS (SELECT grp, text_crc32, total, min(before_size) AS lo, max(before_size + size) AS hi FROM line GROUP BY ALL),
moved AS (
  SELECT cut, CASE WHEN cut * total / 16 - lo <= hi - cut * total / 16 THEN lo ELSE hi END AS edge
  FROM (SELECT *, unnest(range(1, 16)) AS cut FROM ends) WHERE cut * total > lo * 16 AND cut * total <= hi * 16
    AND least(cut * total / 16 - lo, hi - cut * total / 16) <= 0.01::DOUBLE * total / 16
),
plain AS (SELECT *, ((2 * before_size + size)::HUGEINT * 16 // (2 * total))::INT AS n FROM line),
dealt AS (
  SELECT l.*, l.n - coalesce(2 * before_size + size < 2 * a.edge, false)::INT + coalesce(2 * before_size + size >= 2 * b.edge, false)::INT AS shard
  FROM plain l LEFT JOIN moved a ON a.cut = l.n LEFT JOIN moved b ON b.cut = l.n + 1
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM dealt
"""


def over(sql: str, documents: str) -> str:
    """The SQL with another table in the place of documents."""
    return sql.replace("FROM documents", f"FROM {documents}")


#: The stages of the pipeline, each over what the one before keeps.
PIPELINE = f"""
WITH q_docs AS MATERIALIZED ({CLEANED}),
j_docs AS MATERIALIZED (SELECT q_docs.* FROM q_docs JOIN ({over(NEAR_DUPLICATES, "q_docs")}) USING (doc_id) WHERE doc_id = component_id),
c_docs AS MATERIALIZED (SELECT j_docs.* FROM j_docs JOIN ({over(DECONTAMINATE, "j_docs")}) USING (doc_id) WHERE NOT contaminated),
m_docs AS MATERIALIZED (SELECT doc_id, text FROM (SELECT c_docs.doc_id, c_docs.text, unnest(range(copies)) FROM c_docs JOIN ({over(MIX_PARTS, "c_docs")} SELECT doc_id, copies FROM m) USING (doc_id)))
SELECT * FROM ({over(SHARDS, "m_docs")})
"""

SEARCH = rf"""
WITH d AS (SELECT doc_id, {FOLDED} AS words FROM documents),
item AS (SELECT DISTINCT item_id, unnest({FOLDED}) AS term FROM benchmark),
total AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS docs, sum(len(words)) AS terms FROM d),
occ AS (SELECT doc_id, term, len(words)::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occ, total GROUP BY term, docs),
gain AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms::BIGINT))))::BIGINT AS score FROM item JOIN occ USING (term) JOIN w USING (term), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM gain WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

MERKLE_LEVELS = 8  #: of 16 branches each, so 16**8 leaves a source


def leaf_sql(text: str) -> str:
    said = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def merkle_levels(name: str) -> str:
    """Levels 1 and up of trees whose level 0 is {name}0 (tree, spot, h, n): a tree of one node stays as it is.
    l and r are a node's siblings, up its parent's place, n the nodes of its tree."""
    out = []
    for k in range(MERKLE_LEVELS):
        out.append(f"""{name}s{k} AS (SELECT *, CASE WHEN n > 1 THEN spot // 16 ELSE spot END AS up,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY tree, spot // 16 ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY tree, spot // 16 ORDER BY spot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})""")
        out.append(f"{name}{k + 1} AS (SELECT tree, up AS spot, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY spot)) ELSE any_value(h) END AS h, (n + 15) // 16 AS n FROM {name}s{k} GROUP BY tree, up, n)")
    return ",\n".join(out)


def merkle_climb(name: str, first: str) -> str:
    """From {first} (tree, spot, x, proof) through all levels: x becomes the root that it folds to, proof gains the siblings."""
    out, below = [], first
    for k in range(MERKLE_LEVELS):
        out.append(f"""{first}_{k} AS (SELECT p.* REPLACE (s.up AS spot, p.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || p.x || s.r) ELSE p.x END AS x)
  FROM {below} p JOIN {name}s{k} s ON p.tree IS NOT DISTINCT FROM s.tree AND p.spot = s.spot)""")
        below = f"{first}_{k}"
    return ",\n".join(out)


CRC_TABLE = """step AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8)"""

MERKLE = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, source AS tree, {leaf_sql("text")} AS leaf, {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS forged,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, list_extract(tab, xor(c, x) % 256 + 1)), 4294967295::BIGINT), 4294967295) % 5 = 0 AS chosen
  FROM documents, crc_table
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n FROM d),
low0 AS (SELECT tree, spot, leaf AS h, n FROM placed),
{merkle_levels("low")},
top0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS spot, h, count(*) OVER () AS n, tree AS source FROM low{MERKLE_LEVELS}),
{merkle_levels("top")},
climb AS (SELECT doc_id, leaf, tree, spot, CASE WHEN chosen THEN forged ELSE leaf END AS x, '' AS proof FROM placed),
{merkle_climb("low", "climb")},
upper AS (SELECT c.doc_id, c.leaf, t.h AS subroot, 0 AS tree, t.spot, c.x, c.proof FROM climb_{MERKLE_LEVELS - 1} c JOIN top0 t ON c.tree IS NOT DISTINCT FROM t.source),
{merkle_climb("top", "upper")}
SELECT u.doc_id, u.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.x AS folded_root, u.x = r.h AS verified
FROM upper_{MERKLE_LEVELS - 1} u, top{MERKLE_LEVELS} r
"""

#: Five hex digits at a time are four of base 32
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS lead FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), 5 * g::INT + 1, 5))::BIGINT >> b::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM p JOIN first USING (html)
"""
