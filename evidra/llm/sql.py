"""SQL for DuckDB that must agree with the queries of this subpackage."""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op5_chat": """
        WITH every AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&num;') AS body,
                replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '#', '&num;'), ':', '&col;') AS head
            FROM every
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
            CAST(sum(4 + length(head) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
        p AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM hit) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id""",
    "op10_urls": """
        WITH s AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM s),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r(v, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        f AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(v, length(rh || rp) * 1000 + length(rh)) AS v
            FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(translate(host || chr(10) || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '\\A([^\\n]*[.-])?(adult|casino|escort|gambling|porn|warez|xxx)([.-][^\\n]*)?\\n|\\n([^\\n]*/)?(casino|escort|gambling|keygen|malware|phishing|poker|porn|torrent|viagra|warez|xxx)([._-][^/\\n]*)?(/|\\z)|(\\A|[^a-z0-9])(cheap[^a-z0-9]pills|click[^a-z0-9]bait|online[^a-z0-9]lottery|spam[^a-z0-9]farm|sports[^a-z0-9]bet)([^a-z0-9]|\\z)')
            THEN 'block' ELSE 'allow' END) AS verdict
        FROM f""",
    "op7_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, len(embedding) AS d, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
        r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
        c AS (SELECT node, min(other) AS component FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
        FROM embeddings LEFT JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a""",
    "op8_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 90 * (na.n + nb.n - common)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
        c AS (SELECT node, min(other) AS component FROM r GROUP BY node)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id
        FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = node""",
}
