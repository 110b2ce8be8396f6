"""Queries of this subpackage, by name, and the SQL that tells the same where SQL can."""

from __future__ import annotations

from quern.llm.bpe import op2_byte_bpe
from quern.llm.jaccard import op3_ngram_jaccard
from quern.llm.media import op6_netpbm_media
from quern.llm.mixing import op12_sainte_lague
from quern.llm.packing import op1_lexical_packing
from quern.llm.periods import op11_periodic_runs
from quern.llm.ring import op5_ring_sharding
from quern.llm.rules import op7_decision_list
from quern.llm.secrets import op8_random_secrets
from quern.llm.toolcalls import op9_tool_links
from quern.llm.toxicity import op10_toxic_gbdt
from quern.llm.warc import op4_warc_index

QUERIES = {
    "op1_lexical_packing": op1_lexical_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_warc_index": op4_warc_index,
    "op5_ring_sharding": op5_ring_sharding,
    "op6_netpbm_media": op6_netpbm_media,
    "op7_decision_list": op7_decision_list,
    "op8_random_secrets": op8_random_secrets,
    "op9_tool_links": op9_tool_links,
    "op10_toxic_gbdt": op10_toxic_gbdt,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sainte_lague": op12_sainte_lague,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x{09}-\x{0d}\x{20}]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS d, doc_id AS reached FROM documents UNION SELECT links.y, r.reached FROM r JOIN links ON links.x = r.d)
        SELECT d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d
    """,
    "op9_tool_links": """
        WITH RECURSIVE m AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS body, (conv_id + turn) % 8 AS fault,
                   CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
                   CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS asked,
                   CASE WHEN role = 'user' AND conv_id % 2 = 0
                        THEN 'call-' || CASE WHEN conv_id % 10 = 4 AND turn % 4 >= 2 THEN turn - 2 ELSE turn + 2 END END AS after
            FROM conversations),
        n AS (
            SELECT *, CASE WHEN kind = 'result' AND conv_id % 5 = 2 AND turn % 3 = 0 THEN 'lost-' ELSE 'call-' END
                   || CASE WHEN conv_id % 5 = 1 THEN asked - (asked % 4 + 4) % 4 ELSE asked END AS call_id FROM m),
        o AS (SELECT conv_id, call_id, min(turn) AS call_turn, arg_min(after, turn) AS after FROM n WHERE kind = 'call' GROUP BY ALL),
        a AS (SELECT DISTINCT conv_id, call_id FROM n WHERE kind = 'result'),
        up AS (
            SELECT conv_id, call_id, call_id AS at, after, call_turn AS major, 0 AS depth FROM o
            UNION ALL
            SELECT up.conv_id, up.call_id, o.call_id, o.after, greatest(up.major, o.call_turn), up.depth + 1
            FROM up JOIN o ON o.conv_id = up.conv_id AND o.call_id = up.after WHERE up.depth < 60),
        top AS (SELECT conv_id, call_id, max(depth) AS depth, arg_max(major, depth) AS major FROM up GROUP BY ALL),
        c AS (
            SELECT o.conv_id, o.call_id, o.call_turn, o.after IS NULL OR x.call_id IS NOT NULL AS known, top.depth >= 60 AS circular,
                   CASE WHEN top.depth >= 60 THEN o.call_turn ELSE top.major END AS major, CASE WHEN top.depth >= 60 THEN 0 ELSE top.depth END AS depth
            FROM o JOIN top USING (conv_id, call_id) LEFT JOIN o x ON x.conv_id = o.conv_id AND x.call_id = o.after),
        j AS (
            SELECT n.*, c.call_turn, a.call_id IS NOT NULL AS answered, c.major, c.depth, c.known, c.circular,
                   kind = 'call' AND turn = c.call_turn AS owns, kind = 'result' AND c.call_turn IS NOT NULL AS follows,
                   CASE fault WHEN 0 THEN '{"prompt":' || to_json(body) || ',"turn":' || turn || '}'
                        WHEN 1 THEN '{"prompt":' || to_json(body) || ',"role":"user","turn":"' || turn || '"}'
                        WHEN 2 THEN '{"extra":true,"prompt":' || to_json(body) || ',"role":"user","turn":' || turn || '}'
                        WHEN 4 THEN to_json('not json: ' || body)
                        WHEN 5 THEN '[' || turn || ']'
                        ELSE '{"prompt":' || to_json(body) || ',"role":"user","turn":' || turn || '}' END AS arguments
            FROM n LEFT JOIN c USING (conv_id, call_id) LEFT JOIN a USING (conv_id, call_id)),
        r AS (
            SELECT *,
                   CASE WHEN kind = 'text' THEN 'text' WHEN kind = 'call' AND turn > call_turn THEN 'duplicate_id'
                        WHEN kind = 'call' AND NOT answered THEN 'unanswered'
                        WHEN kind = 'result' AND call_turn IS NULL THEN 'orphan' ELSE 'linked' END AS status,
                   CASE WHEN kind <> 'call' THEN NULL WHEN fault = 3 THEN 'unknown_tool' WHEN fault = 4 THEN 'not_json' WHEN fault = 5 THEN 'not_object'
                        WHEN fault = 0 THEN 'missing:role' WHEN fault = 1 THEN 'type:turn' WHEN fault = 2 THEN 'unknown_field'
                        WHEN owns AND NOT known THEN 'unknown_reference' WHEN owns AND circular THEN 'circular_reference' END AS error,
                   CASE kind
                        WHEN 'call' THEN '{' || coalesce('"after":"' || after || '",', '') || '"arguments":' || arguments || ',"id":"' || call_id
                            || '","kind":"call","name":"' || CASE WHEN fault = 3 THEN 'answer' ELSE 'reply' END || '"}'
                        WHEN 'result' THEN '{"content":' || to_json(body) || ',"id":"' || call_id || '","kind":"result"}'
                        ELSE '{"content":' || to_json(body) || ',"kind":"text"}' END AS json
            FROM j)
        SELECT conv_id,
               row_number() OVER (PARTITION BY conv_id ORDER BY
                   CASE WHEN owns OR follows THEN major ELSE turn END, CASE WHEN owns OR follows THEN depth ELSE 0 END,
                   CASE WHEN owns OR follows THEN call_turn ELSE turn END, CASE WHEN owns OR follows THEN call_id ELSE '' END,
                   CASE WHEN follows THEN 1 ELSE 0 END, turn, kind, json) - 1 AS position,
               turn, kind, call_id, status, error, json
        FROM r
    """,
    "op4_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM g
    """,
    "op12_sainte_lague": r"""
        WITH d AS (
            SELECT doc_id, source, substr(md5('mix ' || coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 16) AS key,
                   len(list_filter(string_split_regex(coalesce(text, ''), '[\x{09}-\x{0d}\x{20}]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0))
                   / sum(weight) OVER (ORDER BY most / weight RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        v AS (SELECT *, least(most::DOUBLE, weight * (SELECT min_by(level, most / weight) FROM l WHERE weight * level <= most)) AS target FROM w),
        n AS (SELECT ((2 * sum(source_size) + 16) // 32)::BIGINT AS blocks, count(*) AS sources FROM v),
        i AS (SELECT place, target, unnest(range(0, (target / 16)::BIGINT + sources + 3)) AS i FROM v, n WHERE target > 0),
        won AS (SELECT place FROM i QUALIFY row_number() OVER (ORDER BY target / (2 * i + 1) DESC, place) <= (SELECT blocks FROM n)),
        q AS (SELECT place, count(*) AS seats FROM won GROUP BY place),
        p AS (
            SELECT v.*, least(coalesce(seats, 0) * 16, most)::BIGINT AS words, (source_size + 15) // 16 AS n,
                   CASE WHEN (source_size + 15) // 16 % 999983 <> 0 THEN 999983 WHEN (source_size + 15) // 16 % 999979 <> 0 THEN 999979 ELSE 999961 END AS stride,
                   ('0x' || substr(md5('mix ' || coalesce(source, '')), 1, 8))::BIGINT AS drawn FROM v LEFT JOIN q USING (place)),
        c AS (
            SELECT *, words // source_size AS passes, words % source_size AS rest, drawn % n AS begin, source_size - (n - 1) * 16 AS tail,
                   ((n - 1) * stride + drawn % n) % n AS tail_at FROM p WHERE n > 0),
        o AS (
            SELECT row_number() OVER () AS r, doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
            FROM d),
        b AS (SELECT o.*, c.* EXCLUDE (source), unnest(range(start // 16, (start + size - 1) // 16 + 1)) AS b FROM o JOIN c ON o.source IS NOT DISTINCT FROM c.source WHERE size > 0),
        m AS (SELECT *, (b * stride + begin) % n AS spot FROM b),
        t AS (
            SELECT r, sum(greatest(0, least(start + size - b * 16, CASE WHEN b = n - 1 THEN tail ELSE 16 END,
                   rest - spot * 16 + CASE WHEN spot > tail_at THEN 16 - tail ELSE 0 END) - greatest(start - b * 16, 0))) AS last_pass FROM m GROUP BY r)
        SELECT doc_id, size, v.source_size, v.target, (coalesce(c.passes, 0) * size + coalesce(last_pass, 0))::BIGINT AS taken
        FROM o JOIN v ON o.source IS NOT DISTINCT FROM v.source LEFT JOIN c ON o.source IS NOT DISTINCT FROM c.source LEFT JOIN t USING (r)
    """,
}
