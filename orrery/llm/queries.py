"""The queries of this subpackage and their SQL forms."""

from __future__ import annotations

from orrery.llm.bpe import op7_bpe
from orrery.llm.html_text import op4_html_text
from orrery.llm.media import op8_media
from orrery.llm.decontam import op10_decontaminate
from orrery.llm.line_dedup import op3_line_dedup
from orrery.llm.lm import op2_lm_score
from orrery.llm.neardup import op6_near_duplicates
from orrery.llm.substring_dedup import op5_substring_dedup
from orrery.llm.toxicity import op9_toxicity
from orrery.llm.tokencount import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_text": op4_html_text,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_bpe": op7_bpe,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
}

_WORDS = "list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS win
       FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS g(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, s, z.n, list_slice(w, s, s + z.n - 1) AS win
       FROM d, (SELECT DISTINCT n FROM bw) z, unnest(generate_series(1, greatest(len(w) - z.n + 1, 0))) AS g(s)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM m), unnest(generate_series(s, s + n - 1)) AS g(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP3_SQL = """
WITH l AS (SELECT doc_id, text, CAST(i AS INTEGER) - 1 AS n, string_split(text, chr(10))[i] AS line FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS g(i)),
t AS (SELECT *, list_transform(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
z AS (SELECT doc_id, text, n, w, len(w) - 2 AS r, (len(w) - 1) // 2 AS half FROM t WHERE len(w) > 0),
k AS (SELECT doc_id, text, n, w AS tpl FROM z
      UNION SELECT doc_id, text, n, list_transform(w, lambda x, p: CASE WHEN p - 3 >= s AND p - 3 < s + half THEN '<*>' ELSE x END)
            FROM (SELECT *, unnest([0, (r - half + 1) // 2, r - half]) AS s FROM z WHERE r > 0)
      UNION SELECT doc_id, text, n, list_transform(w, lambda x, p: CASE WHEN p > 2 AND (p - 1) % 3 = j THEN '<*>' ELSE x END) FROM z, (VALUES (0), (1), (2)) v(j) WHERE r > 0),
c AS (SELECT tpl FROM k GROUP BY tpl HAVING count(DISTINCT text) >= 10),
h AS (SELECT k.* FROM k JOIN c USING (tpl)),
f AS (SELECT text, count(DISTINCT n) AS filled FROM z GROUP BY text),
o AS (SELECT text FROM h JOIN f USING (text) GROUP BY text, filled HAVING 5 * (filled - count(DISTINCT n)) >= 2 * filled),
r AS (SELECT tpl FROM h JOIN o USING (text) GROUP BY tpl HAVING count(DISTINCT text) >= 10),
x AS (SELECT DISTINCT doc_id, n FROM h JOIN r USING (tpl))
SELECT doc_id, count(*) AS n_lines, count(x.n) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (x.n IS NULL), '') AS text
FROM l LEFT JOIN x USING (doc_id, n) GROUP BY doc_id
"""

OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g FROM w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL = {"op3_line_dedup": OP3_SQL, "op6_near_duplicates": OP6_SQL, "op10_decontaminate": OP10_SQL}
