"""The thin queries opN_<name> over the operators of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.lexicon import decode, encode

    rows = decode(encode(table(spark, sf_dir, "documents"), byte_bpe()), byte_bpe())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.shared import remainder
    from foliate.llm.toxicity import fit, score

    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.jaccard import near_classes

    return near_classes(table(spark, sf_dir, "documents"), 4, 85, 100)


def _near_sql(words: int, num: int, den: int) -> str:
    """Shingles as strings, all pairs that share one, and the closure of the links."""
    shingle = " || chr(31) || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, chr(31))]
    ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM common WHERE {den} * c >= {num} * (na + nb - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)"""


OP3_SQL = _near_sql(4, 85, 100) + """
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN classes USING (doc_id)
"""


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.hmm import fit, score
    from foliate.llm.shared import remainder

    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = score(docs, fit(docs, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.archive import archived

    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM m
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.chat import format_conversations, read_conversations

    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = read_conversations(format_conversations(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
    + list_sum(list_transform(['[INST]', '[/INST]', '[ANS]', '</s>', '<<SYS>>', '<</SYS>>', '[ROLE]', '[TEXT]', '[/ROLE]'],
        lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS escaped,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 15 ELSE 19 + length(role) END AS marked
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + marked) AS BIGINT) AS formatted_chars
FROM marks GROUP BY conv_id
"""


def op7_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.rans import coded_ids

    ids = coded_ids(table(spark, sf_dir, "documents"), byte_bpe())
    return ids.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), byte_bpe())


def op9_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliate.llm.quality import quality_report

    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    unnest([{'f': 1, 'jump': 100, 'x': n_symbols * 1000 // greatest(n_words, 1)}, {'f': 2, 'jump': 350, 'x': n_dup_lines * 1000 // greatest(n_lines, 1)},
    {'f': 3, 'jump': 300, 'x': n_repeat_words * 1000 // greatest(n_words, 1)}, {'f': 4, 'jump': 200, 'x': n_upper * 1000 // greatest(n_letters, 1)}], recursive := true) FROM c),
b AS (SELECT *, CAST(greatest(length(bin(x)) - 6, 0) AS BIGINT) AS shift FROM v),
k AS (SELECT lang, source, f, jump, shift * 32 + (x >> shift) AS bucket, ((x >> shift) << shift) AS least, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL),
m AS (
  SELECT 0 AS level, * FROM k
  UNION ALL SELECT 1, lang, NULL, f, jump, bucket, least, sum(n) FROM k GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, f, jump, bucket, least, sum(n) FROM k GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, f ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, f) AS total FROM m),
s AS (
  SELECT *, lag(least) OVER (PARTITION BY level, lang, source, f ORDER BY bucket) AS low FROM q
  WHERE greatest(100 * (upto - n) // total + 1, 50) <= least(100 * upto // total, 99)),
t AS (
  SELECT level, lang, source, f, any_value(total) AS total,
    coalesce(arg_min((least + low) // 2, least) FILTER (least - low >= jump AND least >= 3 * low), max(least) + greatest(max(least), any_value(jump))) AS fence
  FROM s GROUP BY ALL),
z AS (
  SELECT a.lang, a.source, a.f, CASE WHEN a.total >= 100 THEN a.fence WHEN l.total >= 100 THEN l.fence ELSE e.fence END AS fence
  FROM t a JOIN t l ON l.level = 1 AND a.lang IS NOT DISTINCT FROM l.lang AND a.f = l.f JOIN t e ON e.level = 2 AND a.f = e.f WHERE a.level = 0),
o AS (
  SELECT b.doc_id, bool_and(coalesce(x <= fence, true)) AS inside
  FROM b LEFT JOIN z ON b.lang IS NOT DISTINCT FROM z.lang AND b.source IS NOT DISTINCT FROM z.source AND b.f = z.f GROUP BY b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept
FROM c JOIN o USING (doc_id)
"""


QUERIES = {"op1_transducer_bpe": op1_transducer_bpe, "op2_toxicity": op2_toxicity, "op3_jaccard": op3_jaccard, "op4_hmm": op4_hmm, "op5_warc": op5_warc, "op6_chat": op6_chat, "op7_rans_ids": op7_rans_ids, "op8_best_fit": op8_best_fit, "op9_threshold_topk": op9_threshold_topk, "op10_quality": op10_quality}

ORACLES: dict[str, str] = {"op3_jaccard": OP3_SQL, "op5_warc": OP5_SQL, "op6_chat": OP6_SQL, "op9_threshold_topk": OP9_SQL, "op10_quality": OP10_SQL}
