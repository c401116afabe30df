"""SQL each query is checked against, where SQL can express it.

Not here: op1 (XXH64 fingerprints), op2 (approximate), op5 (learned), op8 (strings of bytes), op9,
op11 and op13 (token ids), op10 (templates). Their tests compare with brute force.
"""

from __future__ import annotations

WORD, BLANK = r"[^ \t-\r]+", r"[ \t-\r]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g'))
                          AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_substring_dedup": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
                   FROM documents),
        win AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 49], ' ')) AS k
                FROM t, unnest(range(1, len(ws) - 48)) u(s)),
        firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, s + j AS i FROM win JOIN firsts USING (k),
                 unnest(range(0, 50)) r(j) WHERE doc_id > m),
        every AS (SELECT doc_id, i, ws[i] AS word FROM t, unnest(range(1, len(ws) + 1)) u(i)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n
                 FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op6_line_dedup": """
        WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        win AS (SELECT doc_id, s, r, array_to_string(ls[s:s + r - 1], chr(10)) AS k
                FROM t, unnest([1, 2, 3]) v(r), unnest(range(1, len(ls) - r + 2)) u(s)
                WHERE len(list_filter(ls[s:s + r - 1], lambda x: length(trim(x, ' '))
                          >= CASE WHEN r = 3 THEN 1 ELSE 40 END)) > 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY doc_id, s) AS place
                   FROM win),
        gone AS (SELECT DISTINCT doc_id, s + j AS i FROM ranked, unnest(range(0, r)) w(j)
                 WHERE place > 1),
        every AS (SELECT doc_id, i, ls[i] AS line FROM t, unnest(range(1, len(ls) + 1)) u(i)),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n
                 FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(ls), 0) AS n_lines,
               coalesce(len(ls), 0) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op7_source_mix": f"""
        WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))
                          ::BIGINT AS size,
                          ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':'
                           || coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
                     sum(source_size) OVER () AS total FROM s),
        c AS (SELECT *, 3 * source_size AS ceiling,
                     (total - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
                      AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND
                      UNBOUNDED FOLLOWING) AS level
              FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
        f AS (SELECT coalesce(min(level) FILTER (WHERE level <= ceiling / weight), 0) AS final
              FROM (SELECT *, min(ceiling / weight) FILTER (WHERE level <= ceiling / weight)
                    OVER () AS first FROM c) WHERE ceiling / weight = first),
        target AS (SELECT source, source_size, least(ceiling::DOUBLE, final * weight) AS target
                   FROM c, f),
        p AS (SELECT t.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY t.source
                     ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS before
              FROM t JOIN target ON t.source IS NOT DISTINCT FROM target.source),
        e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0
                     THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))
               ::BIGINT AS taken
        FROM e""",
    "op12_lexical_search": f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS ws FROM documents),
        d AS (SELECT r, doc_id, ws, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
        c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
        tf AS (SELECT r, doc_id, n, w, count(*)::BIGINT AS tf FROM d, unnest(ws) u(w) GROUP BY ALL),
        i AS (SELECT item_id, w, count(*)::BIGINT AS k FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS w FROM benchmark) GROUP BY ALL),
        df AS (SELECT w, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
               FROM tf, c GROUP BY w, docs),
        s AS (SELECT item_id, doc_id, r, sum(k * weight * ((1000000000 * tf)
                     // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
              FROM i JOIN df USING (w) JOIN tf USING (w), c GROUP BY ALL)
        SELECT item_id, rank, doc_id, score FROM (
          SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id
                 ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}
