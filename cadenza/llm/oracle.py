"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), p AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM p) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), m AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, n_symbols > 0.3 * word_chars AS f2,
    n_dup_lines > 0.5 * n_lines AS f3, word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words AS f4
  FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(f1::INT)::DOUBLE AS c1, sum(f2::INT)::DOUBLE AS c2, sum(f3::INT)::DOUBLE AS c3, sum(f4::INT)::DOUBLE AS c4
  FROM f WHERE source IS NOT NULL GROUP BY source
), q AS (
  SELECT source, n, unnest([c1, c2, c3, c4]) AS c, unnest([1, 2, 3, 4]) AS rule FROM h
), g AS (
  SELECT rule, sum(c) / sum(n) AS mean, var_pop(c / n) AS v FROM q GROUP BY rule
), s AS (
  SELECT rule, mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM g
), bad AS (
  SELECT source FROM q JOIN s USING (rule) GROUP BY source HAVING max((c + mean * k) / (n + k)) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed,
  NOT f1 AND NOT (source IS NOT NULL AND source IN (SELECT source FROM bad)) AS kept
FROM f
"""

OP2 = r"""
WITH RECURSIVE page AS (
  SELECT row_number() OVER () AS rid, page_id, url, html FROM pages
), tag AS (
  SELECT url, regexp_extract_all(t, '(?is)<link\b[^>]*\brel\s*=\s*(?:canonical\b|"[^">]*\bcanonical\b|''[^''>]*\bcanonical\b)[^>]*>', 0) AS links,
    regexp_extract_all(t, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS metas
  FROM (SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g') AS t FROM page WHERE url IS NOT NULL AND html IS NOT NULL)
), a_tag AS (
  SELECT url, unnest(links) AS a FROM tag
), b_tag AS (
  SELECT url, unnest(metas) AS b FROM tag
), target AS (
  SELECT url, trim(regexp_extract(a, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))', 1)
    || regexp_extract(a, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))', 2)
    || regexp_extract(a, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))', 3)) AS t FROM a_tag
  UNION ALL
  SELECT url, trim(regexp_extract(b, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1)) FROM b_tag
), link AS (
  SELECT url AS u, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^/]*//[^/?#]*)', 1) || t
    ELSE rtrim(regexp_extract(url, '^([^/]*//[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || t END AS v
  FROM (SELECT url, replace(t, '&amp;', '&') AS t FROM target WHERE t <> '')
), keyed AS (
  SELECT url, lower(regexp_extract(k, '^([^:/?#]*://[^/?#]*)', 1)) || substr(k, length(regexp_extract(k, '^([^:/?#]*://[^/?#]*)', 1)) + 1) AS k
  FROM (SELECT url, split_part(url, '#', 1) AS k FROM (SELECT url FROM page WHERE url IS NOT NULL UNION SELECT u FROM link UNION SELECT v FROM link))
), arc AS (
  SELECT a.k AS u, b.k AS v FROM link JOIN keyed a ON a.url = link.u JOIN keyed b ON b.url = link.v
), reach AS (
  SELECT u, v FROM (SELECT u, v FROM arc UNION SELECT v, u FROM arc)
  UNION
  SELECT r.u, s.v FROM reach r JOIN (SELECT u, v FROM arc UNION SELECT v, u FROM arc) s ON s.u = r.v
), part AS (
  SELECT rid, page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM (SELECT rid, page_id, url FROM page UNION ALL SELECT NULL, NULL, k FROM (SELECT u AS k FROM arc UNION SELECT v FROM arc))
), rule(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), own AS (
  SELECT p.rid, p.page_id, p.url, p.host, p.path,
    (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rule WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS rule,
    (SELECT max_by(action, length(rhost || rpath)) FROM rule WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS action
  FROM part p
), grp AS (
  SELECT reach.u AS k, bool_or(own.action = 'allow') AS allowed, bool_or(own.action = 'block') AS blocked
  FROM reach JOIN own ON own.rid IS NULL AND own.url = reach.v GROUP BY reach.u
)
SELECT own.page_id, own.host, own.path, own.rule,
  coalesce(own.action, CASE WHEN grp.allowed THEN 'allow' WHEN grp.blocked THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN keyed ON keyed.url = own.url LEFT JOIN grp ON grp.k = keyed.k
WHERE own.rid IS NOT NULL
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, ws[i:i + least(len(ws), 10) - 1] AS pat, least(len(ws), 10) AS m
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), size AS (
  SELECT DISTINCT m FROM p
), win AS (
  SELECT rid, i, m, ws[i:i + m - 1] AS pat FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, size)
), hit AS (
  SELECT win.rid, win.i, win.m, p.item FROM win JOIN p ON p.m = win.m AND p.pat = win.pat
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS j FROM hit) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(named.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), w AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS pat
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)
), early AS (
  SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY pat) AS gone FROM w
), covered AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM early WHERE gone
), c AS (
  SELECT rid, list(j) AS js FROM covered GROUP BY rid
), words AS (
  SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d
), kept AS (
  SELECT words.rid, string_agg(word, ' ' ORDER BY words.j) AS t FROM words LEFT JOIN covered ON covered.rid = words.rid AND covered.j = words.j
  WHERE covered.rid IS NULL GROUP BY words.rid
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(c.js), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN kept USING (rid)
"""


OP11 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), both_ AS (
  SELECT a.rid AS u, b.rid AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid
), arc AS (
  SELECT u, v FROM both_ JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT u, v FROM arc UNION SELECT r.u, arc.v FROM reach r JOIN arc ON arc.u = r.v
), least_ AS (
  SELECT reach.u AS rid, min(d.doc_id) AS doc_id FROM reach JOIN d ON d.rid = reach.v GROUP BY reach.u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, least_.doc_id) AS component_id,
  coalesce(d.doc_id = least(d.doc_id, least_.doc_id), true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN least_ USING (rid)
"""


OP13 = r"""
WITH id AS (
  SELECT conv, CASE WHEN conv % 5 < 0 THEN conv % 5 + 5 ELSE conv % 5 END AS rest, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(
      list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
  FROM (SELECT DISTINCT conv_id AS conv FROM conversations WHERE conv_id IS NOT NULL)
), turn AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv, list(t ORDER BY i) AS ts FROM turn GROUP BY conv
), built AS (
  SELECT id.conv, CASE WHEN rest = 0 THEN own.ts ELSE coalesce(base.ts[1:xor(crc, 4294967295) % 9], []) || own.ts[xor(crc, 4294967295) % 9 + 1:] END AS ts
  FROM id JOIN own ON own.conv = id.conv LEFT JOIN own base ON base.conv = id.conv - rest
), prefix AS (
  SELECT conv, d, ts[1:d] AS path, d = len(ts) AS ended FROM (SELECT conv, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)
), node AS (
  SELECT path, d, min(conv) AS conv_id, count(*) AS n, CASE WHEN d > 0 THEN strlen(path[d].text) ELSE 0 END AS bytes,
    coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ended), '') AS ids
  FROM prefix GROUP BY path, d
), numbered AS (
  SELECT *, row_number() OVER () AS id FROM node
), kids AS (
  SELECT up.id, count(*) AS n FROM numbered up JOIN numbered k ON k.d = up.d + 1 AND k.path[1:up.d] = up.path GROUP BY up.id
), above AS (
  SELECT id, path[1:unnest(range(0, d + 1))] AS path FROM numbered
), under AS (
  SELECT up.id, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((k.n - 1) * k.bytes)::BIGINT AS saved
  FROM above JOIN numbered up ON up.path = above.path JOIN numbered k ON k.id = above.id LEFT JOIN kids ON kids.id = k.id GROUP BY up.id
)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, under.n_leaves,
  under.saved AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM numbered x JOIN under USING (id) LEFT JOIN kids USING (id) LEFT JOIN numbered up ON up.d = x.d - 1 AND up.path = x.path[1:up.d]
"""


OP12 = r"""
WITH RECURSIVE run AS (
  SELECT doc, run, count(*) AS k, coalesce(doc::VARCHAR, '') || ':' || run AS s FROM (
    SELECT doc_id AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents WHERE text IS NOT NULL
  ) WHERE length(run) > 6 GROUP BY doc, run
), crc AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(s, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h
  FROM run
), word AS (
  SELECT w AS word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS w, k FROM crc
  ) WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2
), cut AS (
  SELECT word, n, p, left(word, p::INT) || '*' || substr(word, (p + 2)::INT) AS same, left(word, p::INT) || substr(word, (p + 2)::INT) AS less
  FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM word)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.same = b.same AND a.word <> b.word
  UNION SELECT cut.less, cut.word, cut.n FROM cut JOIN word ON word.word = cut.less
  UNION SELECT cut.word, word.word, word.n FROM cut JOIN word ON word.word = cut.less
), most AS (
  SELECT word, count(*) AS n_near, max(n) AS best FROM near GROUP BY word
), first_ AS (
  SELECT near.word, min(other) AS form, max(near.n) AS form_n FROM near JOIN most ON most.word = near.word AND near.n = most.best GROUP BY near.word
), form AS (
  SELECT word.word, first_.form, first_.form_n FROM word JOIN first_ USING (word) WHERE first_.form_n >= 10 * word.n
), way AS (
  SELECT word, word AS root, 0 AS steps FROM word
  UNION ALL SELECT way.word, form.form, steps + 1 FROM way JOIN form ON form.word = way.root
), root AS (
  SELECT word, max_by(root, steps) AS root FROM way GROUP BY word
)
SELECT word.word, form.form, root.root, word.n, coalesce(most.n_near, 0)::BIGINT AS n_near, form.form_n
FROM word JOIN root USING (word) LEFT JOIN most USING (word) LEFT JOIN form USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": OP4,
        "op9_decontaminate": OP9,
        "op2_url_filters": OP2,
        "op10_quality_rules": OP10,
        "op11_minhash_dedup": OP11,
        "op12_spelling": OP12,
        "op13_prefix_trie": OP13,
    }
