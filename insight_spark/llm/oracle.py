"""DuckDB SQL of the operators that SQL can express."""

#: A turn takes 23 code points beside its escaped role and text; an example is all turns up to one of the assistant.
OP4 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
), sized AS (
    SELECT *, 23 + length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS size FROM turns
), placed AS (
    SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
           sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS prefix
    FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

#: Damage by crc32 bit by bit, then a dynamic program over rows: states 0 to 3 are nothing, s, u and a.
OP13 = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), checked AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''),
            lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 20 AS kind
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM checked, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
    SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair,
           substr(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS tail
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), counted AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), judged AS (
    SELECT *, CASE WHEN tail = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN tail IN ('.', '!', '?') THEN '' ELSE 't' END AS fault
    FROM counted
), steps(s, initial, t) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(s, t, cost, audit) AS (
    SELECT s, s, 0, '' FROM (VALUES (0), (1), (2), (3)) v(s)
    UNION ALL SELECT s, t, 5, 'I' FROM steps WHERE initial <> 's'
    UNION ALL SELECT a.s, b.t, 10, 'II' FROM steps a JOIN steps b ON a.t = b.s AND a.initial <> 's' AND b.initial <> 's'
), edits AS (
    SELECT conv_id, i, n.s, n.s AS t, 2 AS cost, 'D' AS edit FROM judged, (VALUES (0), (1), (2), (3)) n(s)
    UNION ALL
    SELECT conv_id, i, s, t, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K'
    FROM judged JOIN steps USING (initial) WHERE fault IN ('', 't')
    UNION ALL
    SELECT conv_id, i, s, t, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R'
    FROM judged, steps WHERE steps.initial <> 's' AND fault IN ('', 't')
), moves AS (
    SELECT e.conv_id, e.i, n.s, e.t, n.cost + e.cost AS cost, n.audit || e.edit AS audit
    FROM edits e JOIN inserts n ON n.t = e.s
), best AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit FROM conversations
    UNION ALL
    SELECT conv_id, i, s, w.cost, w.audit FROM (
        SELECT b.conv_id, b.i + 1 AS i, m.t AS s, min({'cost': b.cost + m.cost, 'audit': b.audit || m.audit}) AS w
        FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 AND m.s = b.s
        GROUP BY b.conv_id, b.i, m.t)
), sizes AS (
    SELECT c.conv_id, count(j.i) AS n, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS gaps,
           count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
           count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
    GROUP BY c.conv_id
), closed AS (
    SELECT z.conv_id, min({'cost': b.cost + n.cost, 'audit': b.audit || n.audit}) AS w
    FROM sizes z JOIN best b ON b.conv_id IS NOT DISTINCT FROM z.conv_id AND b.i = z.n
    JOIN inserts n ON n.s = b.s AND n.t IN (0, 3) GROUP BY z.conv_id
), letters AS (
    SELECT conv_id, p, substr(w.audit, p, 1) AS edit,
           length(replace(substr(w.audit, 1, p), 'I', '')) AS i,
           length(replace(substr(w.audit, 1, p), 'D', '')) AS nth
    FROM closed, unnest(range(1, length(w.audit) + 1)) u(p)
), written AS (
    SELECT l.conv_id, l.nth, l.edit, j.role, CASE l.edit WHEN 'I' THEN '' ELSE j.text END AS text,
           max(CASE WHEN l.nth = 1 AND l.edit = 'K' AND j.initial = 's' THEN 1 ELSE 0 END)
               OVER (PARTITION BY l.conv_id) AS headed
    FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i
    WHERE l.edit <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(
        CASE WHEN edit = 'K' THEN role WHEN (nth - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
        chr(10) ORDER BY nth) AS said
    FROM written GROUP BY conv_id
)
SELECT z.conv_id, z.gaps, z.blank, z.duplicate, z.truncated, z.illegal, c.w.cost AS cost, c.w.audit AS audit,
       sha256(coalesce(r.said, '')) AS repaired_sha256
FROM sizes z JOIN closed c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM z.conv_id
"""

#: All phrases of up to four words are counted; DuckDB orders text by UTF-8 bytes, and HUGEINT holds the products.
OP12 = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words
    FROM texts, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) u(piece)
), phrases AS (
    SELECT lang, k, words[i : i + k - 1] AS words, count(*) AS a
    FROM pieces, unnest(range(1, len(words) + 1)) p(i), (VALUES (1), (2), (3), (4)) s(k)
    WHERE i + k - 1 <= len(words) GROUP BY ALL
), sizes AS (
    SELECT lang, sum(a) AS n FROM phrases WHERE k = 1 GROUP BY lang
), often AS (
    SELECT * FROM phrases WHERE a >= 30
), cuts AS (
    SELECT p.lang, p.words, p.k, p.a, c.cut, x.a AS l, y.a AS r,
           CAST(2000000 * CAST(p.a AS HUGEINT) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
    FROM often p, unnest(range(1, p.k)) c(cut)
    JOIN often x ON x.lang = p.lang AND x.words = p.words[1 : c.cut]
    JOIN often y ON y.lang = p.lang AND y.words = p.words[c.cut + 1 : p.k]
    WHERE p.k > 1
), candidates AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), inner_phrases AS (
    SELECT c.lang, c.words[i : i + size - 1] AS words, max(c.a) AS most
    FROM candidates c, (VALUES (2), (3)) s(size), unnest(range(1, c.k - size + 2)) p(i) WHERE size < c.k GROUP BY ALL
), kept AS (
    SELECT c.*, array_to_string(c.words, ' ') AS phrase
    FROM candidates c LEFT JOIN inner_phrases i ON i.lang = c.lang AND i.words = c.words
    WHERE i.most IS NULL OR 100 * CAST(i.most AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

#: Every window of 50 bytes, as hex; null doc_ids come after all others.
OP11 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS place,
           hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (  -- short texts, as taking a part of a long one costs its length
    SELECT row, place, 200 * b AS base, substr(h, 400 * b + 1, 498) AS h FROM texts, unnest(range(0, length(h) // 400 + 1)) u(b)
), windows AS (
    SELECT row, place, base + p AS p, substr(h, 2 * p + 1, 100) AS w
    FROM blocks, unnest(range(0, least(200, length(h) // 2 - 49))) u(p)
), firsts AS (
    SELECT w, min(place) AS place FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
    SELECT row, p, CASE WHEN p > 50 + lag(p) OVER (PARTITION BY row ORDER BY p) THEN 1 ELSE 0 END AS new
    FROM windows JOIN firsts USING (w) WHERE firsts.place < windows.place
), islands AS (
    SELECT row, p, sum(new) OVER (PARTITION BY row ORDER BY p) AS island FROM hits
), spans AS (
    SELECT row, min(p) AS start, max(p) + 50 AS stop FROM islands GROUP BY row, island
), gaps AS (
    SELECT row, start, stop, coalesce(lag(stop) OVER (PARTITION BY row ORDER BY start), 0) AS after FROM spans
), kept AS (
    SELECT row, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS tail,
           string_agg(substr(h, 2 * after + 1, 2 * (start - after)), '' ORDER BY start) AS head
    FROM gaps JOIN texts USING (row) GROUP BY row
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (row)
"""

ORACLES = {"op4_chat_format": OP4, "op11_suffix_dedup": OP11, "op12_collocations": OP12, "op13_conversation_repair": OP13}
