"""SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f'''translate({text}, '{UPPER}', '{LOWER}')''' if lower else text}, '{pattern}')"


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text', ALNUM, True)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', ALNUM, True)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, spot.n, i, item_id FROM spot JOIN win ON spot.n = win.n AND spot.k = win.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', SPACED, True)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 2], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_words('text', SPACED, False)} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, array_to_string(list(x ORDER BY p), ' ') AS t, count(*) AS n
         FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, max(page_id) AS first FROM p GROUP BY x)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (x)
"""


def _told(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_told, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS bad FROM documents),
o AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, * FROM d),
up(lang, l, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM o UNION ALL
  SELECT lang, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, l, i // 2, n),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(l, i, n, h) AS (SELECT 0, i, n, subroot FROM sub UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 2, n),
rt AS (SELECT h AS root FROM top WHERE n = 1),
lev AS (SELECT o.doc_id, o.leaf, o.lang, o.i, a.l, (o.i >> a.l::BIGINT) & 1 AS side, b.h
        FROM o JOIN (SELECT DISTINCT lang, l, n FROM up WHERE n > 1) a ON a.lang IS NOT DISTINCT FROM o.lang
        LEFT JOIN up b ON b.lang IS NOT DISTINCT FROM o.lang AND b.l = a.l AND b.i = xor(o.i >> a.l::BIGINT, 1)
        UNION ALL
        SELECT o.doc_id, o.leaf, o.lang, o.i, 100 + a.l, (s.i >> a.l::BIGINT) & 1, b.h
        FROM o JOIN sub s ON s.lang IS NOT DISTINCT FROM o.lang CROSS JOIN (SELECT DISTINCT l FROM top WHERE n > 1) a
        LEFT JOIN top b ON b.l = a.l AND b.i = xor(s.i >> a.l::BIGINT, 1)),
way AS (SELECT lang, i, list(CASE WHEN h IS NULL THEN '' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY l) AS steps,
               string_agg(h, '' ORDER BY l) AS told FROM lev GROUP BY lang, i),
f AS (SELECT o.doc_id, o.leaf, s.subroot, root, sha256(coalesce(w.told, '')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(o.bad, o.leaf), coalesce(w.steps, [])),
                         lambda x, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || x WHEN s[1] = 'R' THEN x || s[2:] ELSE x END)) AS folded_root
      FROM o JOIN sub s ON s.lang IS NOT DISTINCT FROM o.lang CROSS JOIN rt
      LEFT JOIN way w ON w.lang IS NOT DISTINCT FROM o.lang AND w.i = o.i)
SELECT *, folded_root = root AS verified FROM f
"""
