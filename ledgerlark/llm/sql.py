"""DuckDB SQL for the queries that SQL can express."""

_U32 = "('0x' || substr(md5({}), 1, 8))::UBIGINT::BIGINT"

#: One stretch of a cell's stream, after those before it.
_LEVEL = """
f{k} AS (SELECT *, cell_size - coalesce(sum(size) FILTER (level < {k}) OVER (PARTITION BY source, shard), 0)::BIGINT AS rest_size,
        greatest(quota * block - coalesce(sum(size * copies{k}) FILTER (level < {k}) OVER (PARTITION BY source, shard), 0)::BIGINT, 0) AS lack FROM e{k}),
e{n} AS (SELECT * EXCLUDE (rest_size, lack, copies{k}), CASE WHEN level <> {k} THEN copies{k} WHEN rest_size > 0 THEN
        (least(lack, 3 * rest_size) * (i + 1) + off % rest_size) // rest_size - (least(lack, 3 * rest_size) * i + off % rest_size) // rest_size
      ELSE 0 END::BIGINT AS copies{n} FROM f{k})"""

OP1 = f"""
WITH f AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS id,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
g AS (SELECT coalesce(sum(size), 0)::BIGINT AS total,
             256 AS block,
             greatest(131072, least(16777216, coalesce(sum(size), 0)::BIGINT // 256)) AS shard_words FROM f),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM f GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
          sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
       FROM s1),
s3 AS (SELECT s2.*, g.total, g.block, g.shard_words, (g.total::DOUBLE - caps) / rest::DOUBLE AS level FROM s2, g),
s4 AS (SELECT *, max(CASE WHEN cap / weight > level THEN level END) OVER () AS free FROM s3),
s AS (SELECT source, source_size, total, block,
        CASE WHEN free IS NULL OR cap <= weight * free THEN cap ELSE weight * free END AS target,
        greatest(1, ceil(source_size / shard_words))::BIGINT AS shards FROM s4),
d AS (SELECT f.*, s.source_size, s.target, s.total, s.block, s.shards,
        {_U32.format("'17|shard|' || f.id")} % s.shards AS shard
      FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source),
c0 AS (SELECT source, source_size, target, total, block, shard, sum(size)::BIGINT AS cell_size FROM d GROUP BY ALL),
c AS (SELECT *, ceil(cell_size / block)::BIGINT AS n_blocks FROM c0),
b0 AS (SELECT source, target, total, block, sum(n_blocks)::BIGINT AS n_blocks FROM c GROUP BY ALL),
b AS (SELECT *, round(total / block)::BIGINT AS seats FROM b0),
bq AS (SELECT source, n_blocks, unnest(range(0, 3 * n_blocks)) AS k, target, seats FROM b),
br AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS FIRST, k) AS rank, seats FROM bq WHERE target > 0),
sq AS (SELECT b.source, coalesce(q.n, 0)::BIGINT AS seats
       FROM b LEFT JOIN (SELECT source, count(*) AS n FROM br WHERE rank <= seats GROUP BY source) q ON b.source IS NOT DISTINCT FROM q.source),
cq AS (SELECT c.source, c.shard, sq.seats, c.target * c.cell_size / c.source_size AS votes, unnest(range(0, 3 * c.n_blocks)) AS k
       FROM c JOIN sq ON c.source IS NOT DISTINCT FROM sq.source),
cr AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY votes / (2 * k + 1) DESC, shard, k) AS rank FROM cq WHERE votes > 0),
w AS (SELECT c.*, coalesce(q.n, 0)::BIGINT AS quota,
        {_U32.format("'17|block|' || coalesce(c.source, 'null') || '|' || c.shard::VARCHAR")} % greatest(c.cell_size, 1) AS off
      FROM c LEFT JOIN (SELECT source, shard, count(*) AS n FROM cr WHERE rank <= seats GROUP BY source, shard) q
        ON c.source IS NOT DISTINCT FROM q.source AND c.shard = q.shard),
p AS (SELECT d.doc_id, d.size, d.source, d.shard, d.source_size, d.target, w.quota, w.cell_size, w.off, d.block,
        (sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY length(bin(d.size)) DESC, {_U32.format("'17|order|' || d.id")}, d.id ROWS UNBOUNDED PRECEDING)::BIGINT - d.size) // d.block AS cut
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.shard = w.shard),
e0 AS (SELECT *, dense_rank() OVER (PARTITION BY source, shard ORDER BY cut) - 1 AS i, 0::BIGINT AS copies0,
        (cut * block * 2 >= cell_size)::INT + (cut * block * 4 >= cell_size * 3)::INT + (cut * block * 8 >= cell_size * 7)::INT + (cut * block * 16 >= cell_size * 15)::INT AS level FROM p),
{",".join(_LEVEL.format(k=k, n=k + 1) for k in range(5))}
SELECT doc_id, size, source_size, target, quota, copies5 AS copies, size * copies5 AS taken FROM e5
"""

OP9 = r"""
WITH h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '(?i)casino|cheap-pills|viagra|poker|payday-loan|adult-video|xxx') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER w AS before,
    length(regexp_replace(replace(text, '\', '\\'), '<\|turn\|>|<\|body\|>|<\|next\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>', '\0+', 'g')) AS n_text,
    length(regexp_replace(replace(role, '\', '\\'), '<\|turn\|>|<\|body\|>|<\|next\|>|<\|end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|im_start\|>|<\|im_end\|>', '\0+', 'g')) AS n_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE n_role + 16 END
      + CASE WHEN before IS NOT NULL AND before <> role THEN 7 ELSE 0 END)::BIGINT + 7 AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL = {"op1_mix_sources": OP1, "op9_url_filter": OP9, "op10_chat": OP10}


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of words as texts; hits by equal windows, then by covered words.
ORACLE_SQL["op2_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM items)),
places AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT d.*, l.n, unnest(range(1, len(w) - l.n + 2)) AS s FROM d, (SELECT DISTINCT n FROM items) l WHERE len(w) >= l.n)),
hits AS (SELECT p.doc_id, p.s, p.n, f.item_id FROM places p JOIN phrases f USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: Each window's first place, then the words that later ones cover.
ORACLE_SQL["op6_dedup_substrings"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) AS k FROM places) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS place FROM later),
left_ AS (SELECT a.doc_id, count(*) AS n, string_agg(a.word, ' ' ORDER BY a.place) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.place = g.place GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)"""

#: Pairs by shared shingles, then the least document that links reach.
ORACLE_SQL["op3_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * p.n >= 90 * (a.n + b.n - p.n)),
reach AS (SELECT DISTINCT x AS doc_id, x AS node FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.node),
least_ AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)"""
