"""Queries on text functions and text structure, with their SQL forms where SQL has them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery.functions import lexicon as L
from orrery.functions import structure as U
from orrery.functions import text as T
from orrery.operators import edges as E
from orrery.operators import roles as O

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _docs(spark, d):
    return X.read(spark, d, "documents")


def _values(rows, cols) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) z({', '.join(cols)})"


@query("normalize", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('  ' || text || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || 'end ', '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS text FROM documents")
def normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize(F.concat(F.lit("  "), F.col("text"), F.lit("\r\n\r\n\nend "))).alias("text"))


@query("heading_count", "SELECT doc_id, CAST(len(regexp_extract_all('# ' || replace(text, chr(10), chr(10) || '## '), '(?m)^#{1,6}\\s+')) AS INTEGER) AS n FROM documents")
def heading_count(spark, d):
    return _docs(spark, d).select("doc_id", T.headings(F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))).alias("n"))


_NOISE_SQL = "t"
for _p in L.NOISE:
    _NOISE_SQL = f"regexp_replace({_NOISE_SQL}, '{_p}', '', 'g')"


@query("noise_filter", f"WITH d AS (SELECT doc_id, concat('12:30', chr(10), text, chr(10), '---', chr(10), '1234567890123', chr(10), chr(10), chr(10), '[meta]', chr(10), '/thinking about it', chr(10), source, chr(10), '!!!!') AS t FROM documents) SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_NOISE_SQL}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS t FROM d")
def noise_filter(spark, d):
    t = F.concat(F.lit("12:30\n"), "text", F.lit("\n---\n1234567890123\n\n\n[meta]\n/thinking about it\n"), "source", F.lit("\n!!!!"))
    return _docs(spark, d).select("doc_id", T.drop_noise(t).alias("t"))


@query("title", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(source, '_notes.md') ELSE '' END AS f, CASE doc_id % 4 WHEN 1 THEN concat(text, chr(10), '# A heading of ', lang, chr(10)) WHEN 2 THEN '' ELSE text END AS t FROM documents) SELECT doc_id, coalesce(nullif(replace(regexp_replace(f, '\\.md$', ''), '_', ' '), ''), nullif(trim(regexp_extract(t, '(?m)^#\\s+(.+)$', 1)), ''), list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: len(x) > 0 AND len(x) < 100)[1], '未命名文档') AS title FROM d")
def title(spark, d):
    i = F.col("doc_id") % 4
    f = F.when(i == 0, F.concat("source", F.lit("_notes.md"))).otherwise("")
    t = F.when(i == 1, F.concat("text", F.lit("\n# A heading of "), "lang", F.lit("\n"))).when(i == 2, "").otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", T.title(f, t).alias("title"))


_TOK = f"list_concat(list_filter(regexp_extract_all(lower(text), '[一-鿿]{{2,}}'), lambda t: t NOT IN {_list(L.STOP_ZH)}), list_filter(regexp_extract_all(lower(text), '[a-z]{{2,}}'), lambda t: t NOT IN {_list(L.STOP_EN)}), regexp_extract_all(lower(text), '[0-9]{{2,}}'))"


@query("keywords_tf", f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, word, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS weight FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 50")
def keywords_tf(spark, d):
    # dealt by document once, before its words are taken apart; counts, totals and ranks then need one sort and no further shuffle
    t = _docs(spark, d).select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(T.keyword_tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("weight", F.round(F.col("n") / total, 6)).withColumn("rn", F.row_number().over(w))
    return t.where("rn <= 50").select("doc_id", "word", "weight")


_QT = f"list_slice(list_distinct_keep({_TOK}), 1, 20)"


@query("query_keywords", f"WITH t AS (SELECT doc_id, {_TOK} AS l FROM documents), p AS (SELECT doc_id, l[i] AS word, min(i) AS i FROM t, unnest(generate_series(1, len(l))) g(i) GROUP BY doc_id, l[i]), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM p QUALIFY rn <= 20) SELECT doc_id, word, round(1.0 / count(*) OVER (PARTITION BY doc_id), 6) AS weight FROM r")
def query_keywords(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.query_keywords(F.col("text"))).alias("word", "weight"))


@query("term_gravity", f"""WITH t AS (SELECT doc_id, {_TOK} AS l FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t, unnest(l) u(w) GROUP BY ALL), tf AS (SELECT doc_id, w, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS x FROM c),
q AS (SELECT DISTINCT l[i] AS w FROM t, unnest(generate_series(1, len(l))) g(i) WHERE doc_id = 1 QUALIFY dense_rank() OVER (ORDER BY list_position(l, l[i])) <= 20), k AS (SELECT w, round(1.0 / (SELECT count(*) FROM q), 6) AS y FROM q)
SELECT doc_id, round(least(1.0, sum(y * x) / (SELECT sum(y * y) FROM k)), 6) AS match FROM tf JOIN k USING (w) GROUP BY doc_id HAVING sum(y * x) > 0""")
def term_gravity(spark, d):
    t = _docs(spark, d)
    tf = keywords_all(t)
    q = t.where("doc_id = 1").select(T.query_keywords(F.col("text")).alias("q"))
    return tf.crossJoin(F.broadcast(q)).select("doc_id", F.round(T.term_gravity(F.col("q"), F.col("weights")), 6).alias("match")).where("match > 0")


def keywords_all(t):
    """doc_id, weights: every keyword's share of a text's keywords."""
    c = t.select("doc_id", F.explode(T.keyword_tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("x", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 6))
    return c.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("weights"))


@query("time_extraction", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN 'log-2024-05-06.md' ELSE source END AS f, CASE doc_id % 7 WHEN 0 THEN concat('at 09:15 we met ', text) WHEN 2 THEN concat('on 2023-01-02 it began ', text) WHEN 3 THEN concat('2023年1月2日 开始 ', text) WHEN 6 THEN concat('see 2021/03/04 ', text) ELSE text END AS t, CASE WHEN doc_id % 7 = 5 THEN '2022-12-31T10:00:00' END AS c FROM documents),
x AS (SELECT doc_id, c, regexp_extract(f, '(\\d{4}-\\d{2}-\\d{2})', 1) AS dd, regexp_extract(substr(t, 1, 80), '(\\d{1,2}:\\d{2})', 1) AS cl, regexp_extract(substr(t, 1, 100), '(\\d{4}-\\d{2}-\\d{2})', 1) AS iso, regexp_extract(substr(t, 1, 100), '(\\d{4}/\\d{2}/\\d{2})', 1) AS sl,
 regexp_extract(substr(t, 1, 100), '(\\d{4})年(\\d{1,2})月(\\d{1,2})日', 1) AS y, regexp_extract(substr(t, 1, 100), '(\\d{4})年(\\d{1,2})月(\\d{1,2})日', 2) AS m, regexp_extract(substr(t, 1, 100), '(\\d{4})年(\\d{1,2})月(\\d{1,2})日', 3) AS da FROM d)
SELECT doc_id, CASE WHEN dd <> '' AND cl <> '' THEN dd || ' (' || cl || ')' WHEN dd <> '' THEN dd WHEN iso <> '' THEN iso WHEN sl <> '' THEN sl WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(da, 2, '0') ELSE substr(coalesce(c, ''), 1, 10) END AS time FROM x""")
def time_extraction(spark, d):
    i = F.col("doc_id") % 7
    f = F.when(i < 2, "log-2024-05-06.md").otherwise(F.col("source"))
    t = F.when(i == 0, F.concat(F.lit("at 09:15 we met "), "text")).when(i == 2, F.concat(F.lit("on 2023-01-02 it began "), "text")).when(i == 3, F.concat(F.lit("2023年1月2日 开始 "), "text")).when(i == 6, F.concat(F.lit("see 2021/03/04 "), "text")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", T.time_of(f, t, F.when(i == 5, "2022-12-31T10:00:00")).alias("time"))


@query("summary", """WITH f AS (SELECT doc_id, text, trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(trim(x), '(?i)^>\\s*(工具|Tool|exec|process|read|write|edit):') OR regexp_matches(trim(x), '^[-=]{5,}$'))), ' '), '\\s+', ' ', 'g')) AS fu FROM documents),
h AS (SELECT *, substr(fu, 1, 150) AS head FROM f), l AS (SELECT *, len(regexp_extract(head, '(?s)^(.*[。.！？])', 1)) AS last FROM h)
SELECT doc_id, CASE WHEN fu = '' THEN trim(substr(text, 1, 150)) WHEN len(fu) <= 150 THEN fu WHEN last - 1 > 75 THEN substr(head, 1, last) ELSE head || '...' END AS summary FROM l""")
def summary(spark, d):
    return _docs(spark, d).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("sentence_split", "SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(trim(s)) >= 15)) AS INTEGER) AS n FROM documents")
def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"), 15)).alias("n"))


@query("alias_entities", f"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('We use RAG and `', source, '` today. ', text) WHEN 1 THEN concat(text, ' 检索增强 with ComfyUI') ELSE text END AS t FROM documents), a AS (SELECT * FROM {_values([(c, x.lower()) for c, al in L.ALIASES.items() for x in al], ['c', 'x'])}) SELECT doc_id, c AS entity FROM d JOIN a ON contains(lower(d.t), a.x) UNION SELECT doc_id, unnest(regexp_extract_all(t, '`([^`]+)`', 1)) FROM d""")
def alias_entities(spark, d):
    i = F.col("doc_id") % 3
    t = F.when(i == 0, F.concat(F.lit("We use RAG and `"), "source", F.lit("` today. "), "text")).when(i == 1, F.concat("text", F.lit(" 检索增强 with ComfyUI"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", F.explode(T.alias_entities(t)).alias("entity"))


_ENDS = (".md", ".TXT", ".json", ".py", ".bin", "")


@query("source_types", f"WITH d AS (SELECT doc_id, concat(source, {list(_ENDS)}[doc_id % 6 + 1]) AS f FROM documents) SELECT doc_id, CASE lower(regexp_extract(f, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'md' THEN '日记' WHEN 'txt' THEN '笔记' WHEN 'json' THEN '配置' WHEN 'py' THEN '代码' ELSE '其他' END AS source_type FROM d")
def source_types(spark, d):
    f = F.concat("source", F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("doc_id") % 6 + 1).cast("int")))
    return _docs(spark, d).select("doc_id", T.source_type_of(f).alias("source_type"))


@query("reply_scores", "WITH d AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN text WHEN 1 THEN CAST(turn % 7 AS VARCHAR) WHEN 2 THEN concat('score: ', turn % 9, ' of 5') WHEN 3 THEN concat(' ', turn % 6, '.5 ') ELSE role END AS r FROM conversations) SELECT conv_id, turn, CASE WHEN try_cast(trim(r) AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast(trim(r) AS DOUBLE) / 5 WHEN regexp_extract(r, '([1-5])', 1) <> '' THEN CAST(regexp_extract(r, '([1-5])', 1) AS DOUBLE) / 5 END AS score FROM d")
def reply_scores(spark, d):
    t, i = F.col("turn"), (F.col("conv_id") + F.col("turn")) % 5
    r = F.when(i == 0, F.col("text")).when(i == 1, (t % 7).cast("string")).when(i == 2, F.concat(F.lit("score: "), t % 9, F.lit(" of 5"))).when(i == 3, F.concat(F.lit(" "), t % 6, F.lit(".5 "))).otherwise(F.col("role"))
    return X.read(spark, d, "conversations").select("conv_id", "turn", T.score_of_reply(r).alias("score"))


@query("history_text", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def history_text(spark, d):
    r = X.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("l"))
    return r.select("conv_id", T.history(F.col("l")).alias("history"))


@query("prompt_assembly", "SELECT conv_id, string_agg('[第' || CAST(rn AS VARCHAR) || '段] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def prompt_assembly(spark, d):
    r = X.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return r.select("conv_id", T.prompt(F.transform("l", lambda x: x["text"])).alias("prompt"))


@query("clean_references", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(concat('Shown before (Smith 2019) and [1,2] twice  [3]. ', text), '\\([^)]*\\d{4}[^)]*\\)', '', 'g'), '\\[\\d+(?:,\\s*\\d+)*\\]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def clean_references(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_references(F.concat(F.lit("Shown before (Smith 2019) and [1,2] twice  [3]. "), "text")).alias("clean"))


@query("keyword_document_frequency", "SELECT w, count(*) FILTER (contains(lower(text), w)) AS n FROM documents, (VALUES ('the'), ('stupid'), ('licensed')) z(w) GROUP BY w")
def keyword_document_frequency(spark, d):
    t = _docs(spark, d).agg(*[F.count_if(F.lower("text").contains(w)).alias(w) for w in ("the", "stupid", "licensed")])
    return t.unpivot([], ["the", "stupid", "licensed"], "w", "n")


@query("fusion", f"WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, text FROM documents JOIN embeddings ON doc_id = vec_id), q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT id, round(0.7 * list_inner_product(q, v) + 0.3 * (len(regexp_extract_all(lower(text), 'the')) % 10) / 10.0, 6) AS score FROM s, q")
def fusion(spark, d):
    from orrery.functions import vectors as V
    from orrery.operators.retrieve import fusion as mix

    s = X.spheres(spark, d)
    return s.select("id", F.round(mix(V.dot(V.literal(X.query_vector(spark, d)), F.col("embedding")), F.regexp_count(F.lower("text"), F.lit("the")) % 10 / 10.0), 6).alias("score"))


# -- structure ----------------------------------------------------------------------------------------------------


@query("chunk_recursive")
def chunk_recursive(spark, d):
    c = _docs(spark, d).select("doc_id", F.posexplode(U.chunk_udf("recursive", 2000, 300)("text")).alias("chunk_index", "chunk"))
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("chunk_markdown")
def chunk_markdown(spark, d):
    t = _docs(spark, d).select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# "))).alias("t"))
    return t.select("doc_id", F.posexplode(U.chunk_udf("markdown", 2500, 200)("t")).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.length("c").alias("n_chars"))


@query("chunk_causal")
def chunk_causal(spark, d):
    t = _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return t.select("doc_id", F.posexplode(U.chunk_udf("causal_density", 2000, 200)("t")).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.length("c").alias("n_chars"))


@query("chunk_by_type")
def chunk_by_type(spark, d):
    kind = F.when(F.col("lang") == "fr", "技术笔记").when(F.col("lang") == "de", "学术论文").when(F.col("lang") == "es", "会话记录").otherwise("other")
    t = _docs(spark, d).select("doc_id", "text", kind.alias("k"))
    return t.select("doc_id", F.posexplode(U.chunk_by_type_udf()("text", "k")).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.length("c").alias("n_chars"))


#: Sentences that the documents lack, put after their texts in turn.
_AH = ("基于注意力机制的神经网络模型。", "提出的新方法提高了分类精度。", "数据集的分布特征，通过编码器提取。", "The model is based on attention layers. It improves accuracy.", "冰川融化导致海平面上升很多。", "研究者把模型部署在服务器上。")


def _sentences(spark, d):
    t = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, _AH)), (F.col("doc_id") % len(_AH) + 1).cast("int")))
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), t.alias("text"))


@query("attr_head_pairs")
def attr_head_pairs(spark, d):
    return _sentences(spark, d).select("id", F.explode(U.attr_head_udf("text")).alias("p")).select("id", "p.head", F.array_join("p.attributives", "|").alias("attributives"), "p.full_phrase", "p.rely_on_de")


@query("svo_triples")
def svo_triples(spark, d):
    return _sentences(spark, d).select("id", F.explode(U.triples_udf("text")).alias("p")).select("id", "p.subject", "p.verb", "p.object")


@query("hybrid_triples")
def hybrid_triples(spark, d):
    return _sentences(spark, d).select("id", F.explode(U.hybrid_triples_udf("text")).alias("p")).select("id", "p.subject", "p.verb", "p.object")


@query("role_mentions")
def role_mentions(spark, d):
    return O.mentions(_sentences(spark, d)).select("sphere_id", "entity_id", "entity_text", "role", "seq")


_HAS = lambda c, ms: "(" + " OR ".join(f"contains({c}, '{m}')" for m in ms) + ")"


@query("causal_edges", f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_file, concat(text, CASE WHEN doc_id % 50 = 7 THEN chr(10) || chr(10) || 'It is shown therefore that all of it improves memory by 3.5% here.' WHEN doc_id % 50 = 9 THEN chr(10) || chr(10) || 'The gain is due to the of and to in the text before it.' ELSE '' END) AS text FROM documents), w AS (SELECT id, source_file, p, trim(string_split(text, chr(10) || chr(10))[p]) AS text FROM t, unnest(generate_series(1, len(string_split(text, chr(10) || chr(10))))) g(p)), z AS (SELECT id, source_file, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l, p FROM w WHERE len(text) > 20),
p AS (SELECT id, source_file, p * 100000 + i AS i, trim(l[i]) AS s FROM z, unnest(generate_series(1, len(l))) g(i)),
c AS (SELECT * FROM p WHERE len(s) >= 15 AND {_HAS('lower(substr(s, 1, 100))', L.CAUSE_STRONG + L.CAUSE_WEAK)}), e AS (SELECT * FROM p WHERE len(s) >= 20),
x AS (SELECT c.id, e.id AS other, c.i, e.i AS j, substr(c.s, 1, 200) AS cause, e.s AS effect, list_distinct(string_split_regex(lower(substr(c.s, 1, 200)), '\\s+')[1:15]) AS cw, string_split_regex(lower(e.s), '\\s+')[1:20] AS ew FROM c JOIN e ON c.source_file = e.source_file AND c.id <> e.id),
y AS (SELECT *, CASE WHEN {_HAS('lower(effect)', L.EFFECT)} THEN 0.4 ELSE 0 END + 0.3 * len(list_intersect(cw, ew)) / len(cw) + CASE WHEN len(effect) > 30 AND len(effect) < 300 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(effect, '\\d+%|\\d+\\.\\d+') THEN 0.1 ELSE 0 END AS score FROM x),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY id, other, i ORDER BY round(score, 9) DESC, j) = 1),
f AS (SELECT * FROM b WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id, other ORDER BY i) = 1)
SELECT id AS src, other AS dst, round(least(0.6, greatest(0.1, 0.35 + 0.3 * score)), 6) AS weight, CASE WHEN {_HAS('lower(effect)', L.REVERSE)} THEN 'reverse' WHEN {_HAS('lower(cause)', L.FORWARD)} THEN 'forward' WHEN {_HAS('substr(lower(cause), 1, len(cause) // 2)', L.GENERIC)} THEN 'forward' ELSE 'bidirectional' END AS direction FROM f""")
def causal_edges(spark, d):
    more = F.when(F.col("doc_id") % 50 == 7, "\n\nIt is shown therefore that all of it improves memory by 3.5% here.").when(F.col("doc_id") % 50 == 9, "\n\nThe gain is due to the of and to in the text before it.").otherwise("")
    s = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_file"), F.concat("text", more).alias("text"))
    return E.causal(s).select("src", "dst", F.round("weight", 6).alias("weight"), "direction")
