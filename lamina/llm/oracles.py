"""DuckDB text of the corpus queries that SQL can express, written plainly: every window, string and pair is looked at."""

from __future__ import annotations

_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def words(text: str) -> str:
    return _WORDS.format(text=text)


def crc32(octets: str) -> str:
    """The checksum of a list of octets: each is followed by eight steps of one bit."""
    bits = f"flatten(list_transform({octets}, lambda o: [o, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({bits} AS BIGINT[])), lambda c, x: {step}), 4294967295)"


def octets(text: str) -> str:
    """The UTF-8 octets of a text, as a list of numbers."""
    hexed = f"hex(encode({text}))"
    return f"list_transform(range(1, length({hexed}), 2), lambda i: CAST('0x' || substr({hexed}, i, 2) AS BIGINT))"


URL_FILTER = """
    WITH parts AS (
        SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ),
    p AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM parts
    ),
    r(action, rule_host, rule_path) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    )
    -- The tables' pages hold no canonical links or refreshes, so no page has aliases.
    SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           coalesce(max_by(action, length(rule_host || rule_path)), 'allow') AS verdict, false AS alias_blocked
    FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id, host, path
"""

JACCARD_JOIN = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, {words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
    ),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
        FROM d
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
    reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
    SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = doc_id GROUP BY doc_id
"""

SUBSTRING_DEDUP = f"""
    WITH w AS (
        SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents)
    ),
    k AS (
        SELECT doc_id, pos, word, count(*) OVER f AS size, md5(string_agg(word, ' ') OVER f) AS win
        FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
    ),
    l AS (SELECT doc_id, pos, word, size = 20 AND row_number() OVER (PARTITION BY size = 20, win ORDER BY doc_id, pos) > 1 AS later FROM k),
    c AS (SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM l)
    SELECT doc_id, count(pos) AS n_words, count(pos) FILTER (WHERE gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id
"""

SUFFIX_DEDUP = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    -- Pieces of 500 octets and the 400 after them, as a long text is slow to cut into at many places.
    p AS (SELECT doc_id, length(h) // 2 AS n, 500 * k AS base, substr(h, 1000 * k + 1, 1800) AS piece FROM (SELECT doc_id, h, unnest(range((length(h) // 2 + 499) // 500)) AS k FROM d)),
    b AS (SELECT doc_id, n, base, piece, unnest(range(least(500, n - base))) AS j FROM p),
    s AS (
        SELECT doc_id, base + j AS i, substr(piece, 2 * j + 1, 2) AS octet, base + j + 400 <= n AS whole,
               CASE WHEN base + j + 400 <= n THEN md5(substr(piece, 2 * j + 1, 800)) END AS string
        FROM b
    ),
    r AS (SELECT doc_id, i, octet, whole AND count(*) OVER (PARTITION BY string) > 1 AS again FROM s),
    u AS (SELECT doc_id, i, octet, count(*) FILTER (WHERE again) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM r),
    c AS (SELECT doc_id, i, octet, upto > coalesce(lag(upto, 400) OVER (PARTITION BY doc_id ORDER BY i), 0) AS gone FROM u),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c)
    SELECT doc_id, count(i) AS n_bytes, count(i) FILTER (WHERE gone) AS n_removed, count(i) FILTER (WHERE opens) AS n_spans,
           sha256(unhex(coalesce(string_agg(octet, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
    FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id
"""

PERIODIC_RUNS = f"""
    WITH d AS (
        SELECT doc_id, {words("coalesce(text, '')")} AS ws, {crc32(octets("CAST(doc_id AS VARCHAR)"))} AS h FROM documents
    ),
    g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS chosen, h // 10 AS g FROM d),
    p AS (SELECT *, CASE WHEN chosen THEN g % n END AS a, CASE WHEN chosen THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
    i AS (SELECT *, unnest(range(n)) AS i FROM p),
    w AS (SELECT doc_id, i, n, ws[CASE WHEN chosen AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM i),
    same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i WHERE 2 * (y.i - x.i) <= x.n),
    stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
    long AS (SELECT * FROM stretch WHERE length >= 2 * q),
    run AS (
        -- A stretch that lies within one of a smaller period has that period.
        SELECT * FROM long a WHERE length >= 12 AND NOT EXISTS (
            SELECT 1 FROM long b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.start <= a.start AND b.start + b.length >= a.start + a.length)
    ),
    best AS (SELECT doc_id, unnest(first(struct_pack(start, length, q) ORDER BY length DESC, start, q)) FROM run GROUP BY doc_id),
    digest AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM run GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents LEFT JOIN digest USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SPELLING_VARIANTS = f"""
    WITH RECURSIVE t AS (
        SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS token FROM documents
    ),
    r AS (
        SELECT doc_id, translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t GROUP BY 1, 2
    ),
    h AS (SELECT run, n, {crc32(octets("concat(doc_id, ':', run)"))} AS h FROM r),
    c AS (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h
    ),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
    v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    near AS (
        SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
        UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word
    ),
    best AS (SELECT word, count(*) AS n_near, unnest(first(struct_pack(form := other, form_n := n) ORDER BY n DESC, other)) FROM near GROUP BY word),
    f AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
        FROM w LEFT JOIN best USING (word)
    ),
    chain(word, root, on_to) AS (SELECT word, word, form FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.on_to)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM chain WHERE on_to IS NULL) USING (word)
"""


def _shingle_list(words: str) -> str:
    return f"CASE WHEN len({words}) >= 5 THEN list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' ')) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


DECONTAMINATION = f"""
    WITH dw AS (SELECT doc_id, {words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    iw AS (SELECT item_id, {words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM benchmark),
    ds AS (SELECT doc_id, len(w) AS words, {_shingle_list("w")} AS g FROM dw),
    d AS (SELECT doc_id, words, len(g) AS n, unnest(g) AS s, unnest(range(len(g))) AS p FROM ds),
    i AS (SELECT item_id, len(g) AS m, unnest(g) AS s FROM (SELECT item_id, {_shingle_list("w")} AS g FROM iw)),
    ic AS (SELECT item_id, m, s, count(*) AS c FROM i GROUP BY ALL),
    -- Every window, as long as the item or the whole text, that a shared shingle lies in.
    h AS (
        SELECT doc_id, item_id, words, m, least(n, m) AS size, s, c, unnest(range(greatest(0, p - least(n, m) + 1), least(p, n - least(n, m)) + 1)) AS start
        FROM d JOIN ic USING (s)
    ),
    g AS (SELECT doc_id, item_id, words, m, size, start, s, least(count(*), c) AS c FROM h GROUP BY doc_id, item_id, words, m, size, start, s, c),
    r AS (
        SELECT doc_id, item_id, start, least(words, size + 4) AS n_words, CAST(sum(c) AS DOUBLE) / CAST(size + m - sum(c) AS DOUBLE) AS similarity
        FROM g GROUP BY doc_id, item_id, words, m, size, start
    )
    SELECT doc_id, item_id, start, n_words, similarity FROM r WHERE similarity >= 0.75
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
