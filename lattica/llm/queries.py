"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, chat, embedding_dedup, language_id, lexical, mixing, nearest, packing, passage_dedup, sharding, spelling, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400, texts=True)
    # bytes of a character that the removal cut in two are shown as U+FFFD
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


OP1_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
t AS (SELECT r, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM t WHERE n >= 400)),
a AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM a),
s AS (SELECT r, min(i) AS f, max(i) + 400 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
k AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY f), 1) AS f, f - 1 AS e FROM s
  UNION ALL SELECT t.r, coalesce(max(s.e), 1), any_value(t.n) FROM t LEFT JOIN s ON s.r = t.r GROUP BY 1),
kept AS (SELECT k.r, coalesce(string_agg(CASE WHEN k.f <= k.e THEN hex(t.b[k.f:k.e]) ELSE '' END, '' ORDER BY k.f), '') AS x FROM k JOIN t ON t.r = k.r GROUP BY 1),
sums AS (SELECT r, sum(e - f)::BIGINT AS gone, count(*) AS spans FROM s GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256,
  try(decode(unhex(x))) AS text
FROM t JOIN kept ON kept.r = t.r LEFT JOIN sums ON sums.r = t.r
"""


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(_table(spark, sf_dir, "documents"), shards=24)
    none = F.lit(None).cast("int")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"), "curve"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), coalesce(md5(text), 'null'))), 1, 13))::UBIGINT::DOUBLE
      / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt,
  source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0.0) AS cap_before, coalesce(sum(wt) OVER p, 0.0) AS wt_before,
  sum(wt) OVER () AS wt_all, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM w
  WINDOW p AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((goal - cap_before) / (wt_all - wt_before), k) FILTER (WHERE (goal - cap_before) / (wt_all - wt_before) * wt <= cap) AS lvl
  FROM (SELECT *, row_number() OVER (ORDER BY cap / wt, source NULLS LAST) AS k FROM o)),
t AS (SELECT source, source_size, least(cap, coalesce(wt * lvl, cap))::DOUBLE AS target FROM o, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(r.rate)::BIGINT + CASE WHEN d.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=5, threshold=0.8)


OP4_SQL = r"""
WITH RECURSIVE u AS (SELECT md5(text) AS k, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1),
w AS (SELECT k, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM u),
g AS (SELECT k, array_to_string(l[i:i + 4], ' ') AS g FROM (SELECT k, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
c AS (SELECT k, g, count(*) AS n FROM g GROUP BY ALL),
z AS (SELECT k, sum(n) AS t FROM c GROUP BY 1),
p AS (SELECT a.k AS x, b.k AS y, sum(least(a.n, b.n)) AS o FROM c a JOIN c b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN z a ON a.k = x JOIN z b ON b.k = y WHERE o / (a.t + b.t - o) >= 0.8),
reach AS (SELECT k AS x, k AS y FROM z UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
class AS (SELECT x, min(doc_id) AS class_id FROM reach JOIN documents ON md5(text) = y GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(doc_id = coalesce(class_id, doc_id), true) AS kept
FROM documents LEFT JOIN class ON x = md5(text)
"""


def op5_small_world_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.98)


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
n AS (SELECT x, count(*) AS n FROM link GROUP BY 1),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.DEFAULT_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path FROM u),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
b AS (
  SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_languages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
z AS (SELECT count(*)::BIGINT AS docs, sum(len(l))::BIGINT AS terms FROM d WHERE len(l) > 0),
p AS (SELECT r, doc_id, t, count(*)::BIGINT AS tf, any_value(len(l))::BIGINT AS n FROM (SELECT r, doc_id, l, unnest(l) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY t),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), z GROUP BY item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_replies(chat.conversation_messages(conversations.unionByName(more)), branches=1)
    return chat.read_back(formatted).withColumnRenamed("tree", "conv_id").drop("branch")


OP12_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?(?:INST|ROLE|NAME)\])', '[\\\1\2', 'g')) AS n,
  length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?(?:INST|ROLE|NAME)\])', '[\\\1\2', 'g')) AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 1 + 5 ELSE 7 + r + 8 + 8 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), times=10)


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i::UBIGINT AS i, i::UBIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS l FROM documents),
t AS (SELECT id, w, count(*)::BIGINT AS n FROM (SELECT id, unnest(l) AS w FROM d) WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM t),
h AS (SELECT w, n, xor(list_reduce(bytes, lambda a, x: xor(tab[(1 + (xor(a, x::UBIGINT) & 255))::INT], a >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT DISTINCT word, other, m FROM (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.v = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.v = b.word)),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY m DESC, other) AS f, max(m) AS fn FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN fn >= 10 * n THEN f END AS form, CASE WHEN fn >= 10 * n THEN fn END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_mixing": op3_mixing,
    "op4_bag_minhash": op4_bag_minhash,
    "op5_small_world_search": op5_small_world_search,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL = {"op1_suffix_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op4_bag_minhash": OP4_SQL, "op7_embedding_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_chat_formatting": OP12_SQL, "op13_spelling_variants": OP13_SQL}
