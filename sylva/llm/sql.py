"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, cast(doc_id AS VARCHAR) AS id,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens,
         ('0x' || substr(md5('mix:' || cast(doc_id AS VARCHAR)), 1, 8))::BIGINT % 65536 AS slot
  FROM documents),
src AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY 1 HAVING sum(tokens) > 0),
tot AS (SELECT sum(tokens)::BIGINT AS t, count(*) AS n, min(tokens) / sum(tokens)::DOUBLE AS least FROM src),
goal AS (SELECT -sum(p * ln(p)) + 0.5 * (ln(count(*)) + sum(p * ln(p))) AS h FROM (SELECT tokens / (SELECT t FROM tot)::DOUBLE AS p FROM src)),
cuts AS (
  SELECT 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS e
  UNION ALL
  SELECT i + 1, CASE WHEN h1 <= (SELECT h FROM goal) THEN a ELSE (a + b) / 2 END, CASE WHEN h1 <= (SELECT h FROM goal) THEN (a + b) / 2 ELSE b END,
         CASE WHEN r1 <= 4.0 THEN c ELSE (c + e) / 2 END, CASE WHEN r1 <= 4.0 THEN (c + e) / 2 ELSE e END
  FROM (SELECT i, a, b, c, e,
          (SELECT ln(sum(pow(p, (a + b) / 2))) - (a + b) / 2 * sum(pow(p, (a + b) / 2) * ln(p)) / sum(pow(p, (a + b) / 2)) FROM (SELECT tokens / (SELECT t FROM tot)::DOUBLE AS p FROM src)) AS h1,
          (SELECT pow((SELECT least FROM tot), (c + e) / 2 - 1) / sum(pow(p, (c + e) / 2)) FROM (SELECT tokens / (SELECT t FROM tot)::DOUBLE AS p FROM src)) AS r1
        FROM cuts WHERE i < 40)),
expo AS (SELECT round(greatest(b, e), 6) AS alpha FROM cuts WHERE i = 40),
weighed AS (SELECT source, tokens, pow(tokens / (SELECT t FROM tot)::DOUBLE, (SELECT alpha FROM expo)) AS w FROM src),
quota AS (
  SELECT source, tokens AS source_tokens, round(w / (SELECT sum(w) FROM weighed), 9) AS weight,
         floor(round(w / (SELECT sum(w) FROM weighed), 9) * (SELECT t FROM tot)::DOUBLE)::BIGINT AS quota,
         greatest(1, least(65536, ceil(tokens / 65536.0)))::BIGINT AS n_blocks FROM weighed),
q AS (SELECT *, quota // source_tokens AS epochs, quota % source_tokens AS remain FROM quota),
placed AS (SELECT d.*, q.weight, q.epochs, q.remain, d.slot * q.n_blocks // 65536 AS block FROM d JOIN q USING (source)),
blocks AS (SELECT source, block, epochs, remain, sum(tokens)::BIGINT AS bt,
             ('0x' || substr(md5('mix:' || source || ':' || epochs || ':' || block), 1, 8))::BIGINT AS o FROM placed GROUP BY ALL),
ranked AS (SELECT *, sum(bt) OVER w AS upto, row_number() OVER w - 1 AS mix_block FROM blocks WINDOW w AS (PARTITION BY source ORDER BY o, block)),
state AS (SELECT *, remain - (upto - bt) AS spare, CASE WHEN upto <= remain THEN 1 ELSE 0 END AS fits FROM ranked),
firstcut AS (SELECT source, min(mix_block) AS cut FROM state WHERE fits = 0 AND spare > 0 GROUP BY 1),
used AS (
  SELECT p.*, s.mix_block, s.fits, s.spare, coalesce(s.mix_block = f.cut, false) AS is_cut,
         sum(p.tokens) OVER (PARTITION BY p.source, p.block ORDER BY ('0x' || substr(md5('mix:doc:' || p.epochs || ':' || p.id), 1, 8))::BIGINT, p.id, p.tokens ROWS UNBOUNDED PRECEDING) AS so_far
  FROM placed p JOIN state s USING (source, block) LEFT JOIN firstcut f ON f.source = p.source)
SELECT doc_id, source AS mix_source, tokens AS mix_tokens, weight AS mix_weight, epoch AS mix_epoch, mix_block::BIGINT AS mix_block
FROM (SELECT *, unnest(range(0, (epochs + CASE WHEN fits = 1 OR is_cut AND so_far <= spare THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM used)
"""

_WARC = """
WITH r AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last_id FROM r WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to,
       regexp_replace(url, ' ', '%20', 'g') AS target_uri
FROM r LEFT JOIN m USING (h) JOIN pages USING (page_id)
"""


_DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bi)),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT DISTINCT doc_id, item_id, i, k FROM dwin JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_JACCARD = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, least(3, len(w)) AS k FROM dw WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + k - 1], ' ')) AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM dw UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other)::BIGINT AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_TRIE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT *, octet_length(encode(role)) || ':' || role || text AS said FROM t),
placed AS (SELECT *, sha256(said) AS turn_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) - 1 AS pos FROM named),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, conv_id::VARCHAR AS s, count(*) AS n_own FROM placed GROUP BY 1),
crc AS (  -- CRC-32 of the decimal conv_id, a bit at a time
  SELECT conv_id, s, 0 AS k, 4294967295::BIGINT AS v FROM c
  UNION ALL
  SELECT conv_id, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(s[k // 8 + 1])::BIGINT) ELSE v END AS x FROM crc WHERE k < 8 * length(s))),
h AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % 9 AS h FROM crc WHERE k = 8 * length(s)),
rebuilt AS (
  SELECT c.conv_id, p.pos, p.turn_key, p.text FROM c JOIN h USING (conv_id) JOIN placed p ON p.conv_id = c.base AND p.pos < h.h
  UNION ALL
  SELECT c.conv_id, p.pos + 1000000000, p.turn_key, p.text FROM c JOIN h USING (conv_id) JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= h.h),
ranked AS (SELECT conv_id, turn_key, octet_length(encode(text)) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM rebuilt),
pre AS (SELECT conv_id, d, b, string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM ranked
        UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM pre GROUP BY key, d),
fin AS (SELECT conv_id, key FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) AS k FROM pre) WHERE k = 1),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM fin GROUP BY key),
kids AS (SELECT a.key, count(b.key) AS n FROM node a LEFT JOIN node b ON b.depth = a.depth + 1 AND starts_with(b.key, a.key) GROUP BY a.key),
below AS (SELECT a.key, sum((b.n_convs - 1) * b.b)::BIGINT AS saved, sum(CASE WHEN k.n = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves
          FROM node a JOIN node b ON starts_with(b.key, a.key) JOIN kids k ON k.key = b.key GROUP BY a.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, kids.n AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node n JOIN kids USING (key) JOIN below USING (key) LEFT JOIN ends USING (key)
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.key = left(n.key, 64 * (n.depth - 1)::INT)
"""

_PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS cut_at FROM cand),
scored AS (SELECT cut.lang, cut.k, cut.phrase, a, cut_at, l.c AS l, r.c AS r, tot.n AS n, (1000::HUGEINT * a * tot.n) // (l.c::HUGEINT * r.c) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:cut_at], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[cut_at + 1:cut.k], ' ') JOIN tot ON tot.lang = cut.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) AS o FROM scored) WHERE o = 1),
sub AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
inside AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM sub)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.a >= b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def _urls(rules, words, ends) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in rules)
    w, c = ([f"'{x}'" for x in y] for y in (words, ends))
    return rf"""
WITH w(a) AS (SELECT unnest([{', '.join(w)}])), c(c) AS (SELECT unnest([{', '.join(c)}])),
e(eh, ep, verdict, is_rule) AS (SELECT * FROM (VALUES {values}) UNION ALL SELECT x.a || '-' || y.a || '.' || c, '/', 'block', false FROM w x, w y, c WHERE x.a <> y.a),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
best AS (SELECT is_rule, page_id, eh || ep AS entry, verdict, row_number() OVER (PARTITION BY page_id, is_rule ORDER BY length(eh || ep) DESC, length(eh) DESC) AS k
         FROM hp JOIN e ON (host = eh OR ends_with(host, '.' || eh)) AND starts_with(path, ep))
SELECT page_id, host, path, r.entry AS rule, coalesce(r.verdict, s.verdict, 'allow') AS verdict, CASE WHEN r.entry IS NULL THEN s.entry END AS listed
FROM hp LEFT JOIN (SELECT * FROM best WHERE k = 1 AND is_rule) r USING (page_id) LEFT JOIN (SELECT * FROM best WHERE k = 1 AND NOT is_rule) s USING (page_id)
"""


def oracles(rules, words, ends) -> dict[str, str]:
    return {"op2_url_filter": _urls(rules, words, ends), "op3_source_mixing": _MIX, "op4_decontamination": _DECONTAMINATION, "op8_jaccard_join": _JACCARD, "op10_warc": _WARC, "op12_prefix_trie": _TRIE, "op13_collocations": _PHRASES}
