"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm import chat, decontaminate, divergence, exact_dedup, lm, ngram_join, quality, resampling, sentencepiece_codec, sharding, suffix_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


#: Small enough that buckets split at every size of the tables.
SHARD_BYTES = 256 << 10


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The conversation that op6 adds to the table.
ESCAPED = r"\### Assistant: </turn> ok"


def mixed_records(rows: DataFrame) -> DataFrame:
    """conv_id, turn, record: turns as JSON records of four layouts, as conversations from several makers come; a conversation keeps to one or two of them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    aliases = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    kind, theirs = F.expr("pmod(coalesce(conv_id, 0), 3)"), F.element_at(aliases, role)
    listed = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.lit("shared").alias("source"), F.array(F.struct(theirs.alias("from"), text.alias("value"))).alias("conversations")))
    plain = lambda name: F.to_json(F.struct(role.alias("role"), text.alias(name)))
    return rows.select("conv_id", "turn", F.when(kind == 0, plain("text")).when(kind == 1, listed).when(theirs.isNotNull(), shared).otherwise(plain("content")).alias("record"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 (rows that a table has of that number itself are turns of it), as records of mixed layouts."""
    added = spark.createDataFrame([(-7, 0, "user", ESCAPED), (-7, 1, "assistant", ESCAPED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_conversations(chat.format_conversations(chat.canonical_turns(mixed_records(rows))), in_order=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_words=1)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_sharding": """
WITH k AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS doc_bytes
  FROM documents),
up AS (SELECT d.depth, k.h >> CAST(60 - d.depth AS INTEGER) AS prefix, k.* FROM k, (SELECT unnest(range(0, 61)) AS depth) d),
sums AS (SELECT depth, prefix, CAST(sum(doc_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS alone FROM up GROUP BY 1, 2),
leaf AS (SELECT up.doc_id, up.h, up.doc_bytes, min(up.depth) AS depth FROM up JOIN sums USING (depth, prefix) WHERE shard_bytes <= 262144 OR alone GROUP BY 1, 2, 3)
SELECT l.doc_id, l.doc_bytes, CASE WHEN l.depth = 0 THEN '' ELSE substr(lpad(bin(s.prefix), 60, '0'), CAST(61 - l.depth AS INTEGER)) END AS shard_id,
       l.depth AS shard_depth, s.shard_bytes, s.shard_docs, s.shard_bytes > 262144 AS oversized
FROM leaf l JOIN sums s ON s.depth = l.depth AND s.prefix = l.h >> CAST(60 - l.depth AS INTEGER)
""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op6_chat_formatting": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, 2 * (length(text) + length(role)) - length(translate(text || role, '\\|', '')) + 13 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op5_decontamination": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
bw AS (SELECT item_id, len(w) AS item_words, least(len(w), 13) AS window_words, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM b),
m AS (SELECT doc_id, item_id, item_words, window_words, dw.p - bw.p AS doc_word, bw.p AS p FROM dw JOIN bw USING (word)),
big AS (SELECT doc_id, item_id, doc_word FROM m GROUP BY 1, 2, 3, window_words HAVING count(*) >= CASE WHEN window_words < 6 THEN window_words ELSE ceil(0.8 * window_words) END AND window_words >= 4),
c AS (SELECT m.*, count(*) OVER (PARTITION BY doc_id, item_id, doc_word ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n_matched FROM m JOIN big USING (doc_id, item_id, doc_word)),
ok AS (SELECT doc_id, item_id, item_words, window_words, n_matched, doc_word FROM c WHERE n_matched >= CASE WHEN window_words < 6 THEN window_words ELSE ceil(0.8 * window_words) END)
SELECT doc_id, item_id, item_words, window_words, n_matched, min(doc_word) AS doc_word
FROM ok GROUP BY doc_id, item_id, item_words, window_words, n_matched
HAVING n_matched = (SELECT max(n_matched) FROM ok o WHERE o.doc_id = ok.doc_id AND o.item_id = ok.item_id)
""",
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT rid, s FROM (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT rid, count(*) AS c FROM g GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
h AS (SELECT x, y FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y WHERE i >= 0.8 * (u.c + v.c - i) - 1e-9),
e AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT r.x AS rid, min(d.doc_id) AS class_id FROM r JOIN d ON d.rid = r.y GROUP BY 1),
l AS (SELECT x AS rid, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, k.class_id, coalesce(l.n_links, 0) AS n_links, CASE WHEN len(w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w) END AS n_copies, CASE WHEN len(w) = 0 THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY w) END AS copy_id
FROM d JOIN k USING (rid) LEFT JOIN l USING (rid)
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits, count(*) OVER (PARTITION BY h) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, i * 5 + 1, 1) AS INTEGER) * 16 + CAST(substr(bits, i * 5 + 2, 1) AS INTEGER) * 8 + CAST(substr(bits, i * 5 + 3, 1) AS INTEGER) * 4 + CAST(substr(bits, i * 5 + 4, 1) AS INTEGER) * 2 + CAST(substr(bits, i * 5 + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM x
""",
    "op11_importance_resampling": f"""
WITH tab AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, list_transform(range(0, strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
h AS (SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM v, tab),
g AS (SELECT bucket, CAST(count(*) FILTER (o = 1) AS DOUBLE) AS s, CAST(count(*) FILTER (o = 2) AS DOUBLE) AS t FROM (SELECT word, 1 AS o FROM dw UNION ALL SELECT word, 2 FROM bw) JOIN h USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((g.t + 1) * (n.s + 10000) / ((g.s + 1) * (n.t + 10000)))) AS BIGINT) AS gain FROM g, n),
w AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN h USING (word) JOIN gain USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= floor(10 * n / 100) THEN place END AS rank FROM z
""",
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
l AS (SELECT lang, sum(size) AS size FROM g GROUP BY 1),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (size + v) AS BIGINT) AS p FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 1) // (l.size + v) AS BIGINT) AS q FROM p JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term, l.size, v),
two AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
