"""DuckDB SQL for what SQL can say of these operators."""

from __future__ import annotations

from gaugewell.llm.secrets import BASE, RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secret_scans() -> str:
    """Findings by the rules' patterns: each match is taken with all that lies before it,
    so that the lengths add up to positions."""
    lists = []
    for number, rule in enumerate(RULES):
        own = f"(?i:{rule.pattern})" if rule.fold else f"(?:{rule.pattern})"
        whole = _text(f"(?s)(.*?)({own})")
        parts = [f"regexp_extract_all(t, {whole}, {group})" for group in (1, 2, rule.group + 2)]
        lists.append(f"""
            CASE WHEN regexp_matches(t, {_text(own)}) THEN list_filter(list_transform(
                list_zip({parts[0]}, {parts[1]}, {parts[2]}),
                lambda m, i: {{'s': 0, 'k': {number}, 'kind': '{rule.kind}', 'before': m[1], 'all': m[2], 'measured': m[3], 'i': i}}), lambda m: true)
            ELSE [] END AS list{number}""")
    placed = []
    for number, rule in enumerate(RULES):
        start = (f"(list_sum(list_transform(list{number}[1:m.i], lambda x: length(x.before)))"
                 f" + coalesce(list_sum(list_transform(list{number}[1:m.i - 1], lambda x: length(x.\"all\"))), 0))::BIGINT")
        placed.append(f"""list_transform(list_filter(list{number}, lambda m: length(m.measured) >= {rule.least}),
            lambda m: {{'s': {start}, 'k': {number}, 'kind': '{rule.kind}', 'e': {start} + length(m."all")}})""")
    joined = "array_to_string(list_transform({}, lambda f: f.kind || ':' || f.s || ':' || f.e), ',')"
    base = f"list_filter(found, lambda f: f.k < {len(BASE)})"
    counts = ", ".join(f"len(list_filter(found, lambda f: f.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        matches AS (SELECT doc_id, {", ".join(lists)} FROM texts),
        findings AS (SELECT doc_id, list_sort(list_concat({", ".join(placed)})) AS found FROM matches)
        SELECT doc_id, {counts}, sha256({joined.format(base)}) AS base_sha256, {joined.format("found")} AS spans
        FROM findings"""


def substring_dedup(window: int = 35) -> str:
    """Every window as text, counted over the table; words inside a repeated one go."""
    return rf"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
        windows AS (SELECT r, p, md5(string_agg(word, ' ') OVER ahead) AS key, count(*) OVER ahead AS size FROM words
            WINDOW ahead AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
        repeated AS (SELECT r, p, count(*) OVER (PARTITION BY key) > 1 AS again FROM windows WHERE size = {window}),
        marked AS (SELECT words.r, words.p, word, coalesce(bool_or(again) OVER (PARTITION BY words.r ORDER BY words.p
            ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), false) AS gone
            FROM words LEFT JOIN repeated ON words.r = repeated.r AND words.p = repeated.p),
        kept AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS k
            FROM marked GROUP BY r)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM texts LEFT JOIN kept ON texts.r = kept.r"""


def warc(least: int = 1000) -> str:
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        r AS (SELECT *, CASE WHEN strlen(html) >= {least} THEN max(page_id) OVER (PARTITION BY html) END AS responds FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
            CASE WHEN responds <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN responds <> page_id THEN responds END AS refers_to FROM r"""


def _crc32(value: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: each byte enters, then eight shifts."""
    octets = f"list_transform(range(1, 1 + strlen({value})), lambda i: ('0x' || substr(hex({value}), 2 * i - 1, 2))::BIGINT)"
    shift = "lambda a, z: xor(a >> 1, (a & 1) * 3988292384)"
    byte = f"list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], {shift})"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: {byte}), 4294967295)"


def near_vectors(threshold: float = 0.9) -> str:
    """All pairs by cosine; components by following links."""
    return f"""
        WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        valid AS (SELECT * FROM rows WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(v, lambda x: x <> 0)) > 0),
        links AS (SELECT a.r AS x, b.r AS y, b.vec_id AS id FROM valid a JOIN valid b ON a.r <> b.r AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
        reached AS (SELECT r AS x, r AS y FROM valid UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x),
        least AS (SELECT x, min(vec_id) AS component_id FROM reached JOIN rows ON reached.y = rows.r GROUP BY x),
        degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
            coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
        FROM rows LEFT JOIN least ON least.x = r LEFT JOIN degree ON degree.x = r"""


def prefix_trie(group: int = 5, cuts: int = 9) -> str:
    """Every prefix of every rebuilt conversation as a list; subtrees by all prefixes of a prefix."""
    return f"""
        WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce("text", '')}} ORDER BY turn NULLS FIRST,
                substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce("text", '')), 1, 32)) AS t
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        cut AS (SELECT *, {_crc32("conv_id::VARCHAR")} % {cuts} AS h FROM own),
        rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t
            FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {group}),
        passed AS (SELECT conv_id, d, t[1:d] AS p, d = len(t) AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
        nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM passed GROUP BY p, d),
        children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children,
            CASE WHEN d > 0 THEN (n_convs - 1) * strlen(nodes.p[d].text) ELSE 0 END AS saved FROM nodes LEFT JOIN children ON nodes.p = children.p),
        above AS (SELECT p[1:a] AS p, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted)),
        subtrees AS (SELECT p, sum(saved)::BIGINT AS saved_tokens, (count(*) FILTER (n_children = 0))::BIGINT AS n_leaves FROM above GROUP BY p)
        SELECT c.conv_id, c.d::BIGINT AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
        FROM counted c JOIN subtrees ON c.p = subtrees.p LEFT JOIN nodes up ON c.d > 0 AND up.p = c.p[1:c.d - 1]"""


def spelling_variants(letters: int = 5, least: int = 3, damaged: int = 97) -> str:
    """Near words by what is left when a letter goes: of one of them, or of both at the same place."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{capitals}', '{capitals.lower()}') AS r
            FROM documents),
        counted AS (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= {letters} GROUP BY doc_id, r),
        hashed AS (SELECT *, doc_id::VARCHAR || ':' || r AS s FROM counted),
        marked AS (SELECT *, {_crc32("s")} AS h FROM hashed),
        results AS (SELECT CASE WHEN h % {damaged} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM marked),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= {letters} GROUP BY word HAVING sum(n) >= {least}),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
        near AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
        best AS (SELECT x, count(*) AS n_near, min({{'o': -m, 'y': y}}) AS f FROM near GROUP BY x),
        forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.o >= 2 * n THEN f.y END AS form, CASE WHEN -f.o >= 2 * n THEN -f.o END AS form_n
            FROM words LEFT JOIN best ON word = x),
        ways AS (SELECT word, word AS root, form AS next FROM forms
            UNION ALL SELECT w.word, w.next, f.form FROM ways w JOIN forms f ON f.word = w.next)
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word AND w.next IS NULL"""
