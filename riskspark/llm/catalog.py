"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.warc import round_trip

    return round_trip(spark, _table(spark, sf_dir, "pages"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.decontaminate import find_matches

    return find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Key of the surrogates in the registered queries; a deployment passes its own secret.
PII_KEY = "registered-query-key"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.pii import replace_pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PII_KEY)


def op5_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op7_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from riskspark.llm.chat import prefix_tree, read_back

    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return read_back(*prefix_tree(rows, *tokenizer), *tokenizer)


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm import sharding
    from riskspark.llm.common import shared_path

    placed = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), n_shards=8)
    path = shared_path(spark, "shards")
    sharding.write_shards(placed, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return spark.read.schema(placed.schema).parquet(path).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer())


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.line_counts import drop_repeated_lines

    return drop_repeated_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.resampling import importance_resample

    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("version")


QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_cgk_decontaminate": op3_cgk_decontaminate,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_zstd_toxicity": op5_zstd_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_prefix_tree": op7_chat_prefix_tree,
    "op8_hypergeometric_shards": op8_hypergeometric_shards,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_nn_descent": op10_nn_descent,
    "op11_line_counts": op11_line_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance_resample": op13_importance_resample,
}

def _sql_base32(hex40: str) -> str:
    """Base32 of 20 bytes given as 40 hex digits: eight 5-bit letters for every 10 digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [f"('0x' || substr({hex40}, {1 + 10 * k}, 10))::BIGINT" for k in range(4)]
    return " || ".join(f"substr('{letters}', (({p} >> {shift}) & 31)::INTEGER + 1, 1)" for p in parts for shift in range(35, -1, -5))


def _sql_escaped(text: str, role: bool = False) -> str:
    """Characters of a text after escaping (chat.escape)."""
    def count(what: str) -> str:
        return f"(length({text}) - length(replace({text}, {what}, ''))) // length({what})"

    hashes = f"{count(chr(39) + '#' + chr(39))} - len(regexp_extract_all({text}, '#+'))"
    more = [count("chr(92)"), hashes, count("'</turn>'")] + ([count(f"'{c}'") if c == ":" else count(f"chr({ord(c)})") for c in ":\n\r"] if role else [])
    return f"(length({text}) + " + " + ".join(more) + ")"


#: DuckDB statements of the queries that SQL can express. Fingerprints with a seeded hash, trained
#: dictionaries, edit distances over windows, keyed surrogates, random draws and tokenisers are tested
#: against brute force, round trips or held-out accuracy instead.
ORACLES: dict[str, str] = {
    "op1_warc_chunks": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, sha1(body) AS h, strlen(body) AS n FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_sql_base32('h')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN page_id = first THEN greatest(1, CAST(ceil(n / 1048576.0) AS BIGINT)) ELSE 1 END::BIGINT AS n_chunks FROM d""",
    "op7_chat_prefix_tree": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', chr(92) || '### Assistant: </turn> ok'),
                                           (-7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + {_sql_escaped('role', True)} + 2 + {_sql_escaped('text')} + 8)::BIGINT AS formatted_chars FROM o GROUP BY conv_id""",
    "op10_nn_descent": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, c.low)::BIGINT AS component_id,
       e.vec_id = least(e.vec_id, c.low) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id""",
    "op11_line_counts": """
WITH l AS (SELECT doc_id, unnest(p.lines) AS line, generate_subscripts(p.lines, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) p),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, r.first IS NOT NULL AND k.doc_id <> r.first AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op12_filter_audit": """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT d.doc_id, part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
             (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
             + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT AS fails
      FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT o.filter_order || f.f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) f
                    WHERE NOT contains(o.filter_order, f.f)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1))::INT AS own,
             list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''),
                                     lambda x: CASE WHEN x = '' THEN 0 ELSE (1 << (instr('ABCDE', x) - 1)) END))::INT AS before
      FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE length(filter_order) = 5)),
a AS (SELECT part, filter_order, step, letter,
             coalesce(sum(n) FILTER ((fails & before) = 0 AND (fails & own) = 0), 0) AS kept,
             coalesce(sum(n) FILTER ((fails & before) = 0 AND (fails & own) <> 0), 0) AS removed,
             coalesce(sum(n) FILTER ((fails & before) <> 0 AND (fails & own) <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER ((fails & before) = 0 AND (fails & own) <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER ((fails & before) = 0 AND (fails & own) <> 0), 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a""",
}
