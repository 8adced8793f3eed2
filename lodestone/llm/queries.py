"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bin_packing, bpe_trie, exact_dedup, hamming_search, language_kernel, lexical_search, lz_dedup, ngram_join, periodic_runs, quality_rules, quality_trees, token_counts, toxicity_cnn
from lodestone.llm.shared import table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(df: DataFrame, of: int, held_out: int) -> F.Column:
    return (F.crc32(df["doc_id"].cast("string").cast("binary")) % of == held_out).alias("held_out")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 1 inserts every document under both tokenizers, batch 2 deletes exact copies, batch 3 revises
    the counts that symbols change; batch 2 comes twice."""
    return _rolled_up(spark, table(token_counts.ledger(_read(spark, sf_dir, "documents")), "ledger"))


def _rolled_up(spark: SparkSession, rows: DataFrame) -> DataFrame:
    kept, feed = F.col("doc_id") == F.col("first_id"), token_counts.change_feed
    copies = feed(rows.where(~kept), 2, F.col("tokens"), None)
    revised = feed(rows.where(kept & (F.col("tokens") != F.col("plain_tokens"))), 3, F.col("tokens"), F.col("plain_tokens"))
    state = token_counts.Rollup(spark)
    for changes in (feed(rows, 1, None, F.col("tokens")), copies, revised, copies):
        state.commit(changes)
    return state.totals()


def token_counts_of_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches under a third version, the byte-level BPE of 50,000 tokens, which SQL can't count; a test counts by the library."""
    docs = _read(spark, sf_dir, "documents")
    return _rolled_up(spark, table(token_counts.bpe_ledger(docs, tokenizer_path(), "byte-bpe-50k"), "ledger"))


def op2_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lz_dedup.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return hamming_search.search(rows, rows.where("vec_id % 20 = 0"), 20)


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_cnn.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), of=5, held_out=0)
    return out.select("doc_id", _held_out(out, 5, 0), "score", "predicted")


def op5_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = language_kernel.identify(docs, language_kernel.learn(docs, of=4, held_out=2))
    return out.select("doc_id", _held_out(out, 4, 2), "lang_pred", "score")


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_trees.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), of=3, held_out=1)
    return out.select("doc_id", _held_out(out, 3, 1), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"), 3, 90)


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_trie.encode(_read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 20)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents"))


def _repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by crc32 of doc_id) repeat some of their words from a place on."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("words")
    g = F.floor(F.col("h") / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h")).where("h % 10 = 0").withColumn("words", words)
    placed = chosen.withColumn("a", F.when(n > 0, g % n).otherwise(0)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = F.expr("transform(sequence(0L, size(words) - 1L), i -> get(words, cast(if(i < a, i, a + (i - a) % p) as int)))")
    changed = placed.select("doc_id", F.when(n > 0, F.array_join(at, " ")).otherwise("").alias("text"))
    return docs.select("doc_id", "text", h.alias("h")).where("h % 10 <> 0").select("doc_id", "text").unionByName(changed)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.detect(_repeating(_read(spark, sf_dir, "documents")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as n, r.start as start, r.period as period)))")
    listed = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    hashed = [F.sha2(F.encode(text, "UTF-8"), 256).alias(name) for name, text in (("runs_sha256", listed), ("collapsed_sha256", F.col("collapsed")))]
    length = -F.col("top.n")
    milli = F.expr("(1000 * -top.n) div top.period").alias("exponent_milli")
    return out.withColumn("top", longest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", length.alias("length"), "top.period", milli, *hashed)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lz_dedup, op3_hamming_search, op4_toxicity_cnn, op5_language_kernel, op6_quality_trees, op7_quality_rules, op8_ngram_join, op9_bpe_trie, op10_bin_packing, op11_lexical_search, op12_exact_dedup, op13_periodic_runs, pipeline, token_counts_of_bpe)}

ORACLE = {
    "op1_token_counts": r"""
WITH firsts AS (
  SELECT source, lang, coalesce(text, '') AS text, translate(coalesce(text, ''), '#*$%&|<>', '') AS plain
  FROM documents WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(plain, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM firsts GROUP BY source, lang
UNION ALL
SELECT source, lang, 'marks-1', count(*), CAST(sum(len(regexp_extract_all(plain, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))) AS BIGINT)
FROM firsts GROUP BY source, lang""",
    "op2_lz_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS k FROM w, range(0, greatest(len(ws) - 12, 0)) AS r(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM win) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM dup, range(0, 13) AS r(j)),
each AS (SELECT w.doc_id, p AS pos, ws[p + 1] AS word FROM w, range(0, len(ws)) AS r(p)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.pos) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_lexical_search": r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS low),
held AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, upper, low), re)) AS term FROM documents, pattern WHERE doc_id IS NOT NULL),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, upper, low), re)) AS term FROM benchmark, pattern WHERE item_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
lens AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lens),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d""",
    "op13_periodic_runs": r"""
WITH crc_table AS (
  SELECT b AS ix, list_reduce(list_prepend(CAST(b AS BIGINT), range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(0, 256) AS r(b)),
crcs AS (SELECT list(v ORDER BY ix) AS t FROM crc_table),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
h AS (
  SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM d, crcs),
p AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
w AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[1 + i] END AS word FROM q, range(0, n) AS r(i)),
grams AS (
  SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) AS k, lead(word, 5) OVER o AS last_word
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i < x.i WHERE x.last_word IS NOT NULL AND y.last_word IS NOT NULL),
isles AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + 5 + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, lag, isle),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM isles WHERE length >= greatest(12, 2 * lag) GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
    min(row(-length, start, period)) AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, start + period + j AS i FROM runs, range(0, length - period) AS r(j)),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top[2] AS BIGINT) AS start, CAST(-top[1] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period,
  CAST(1000 * -top[1] // top[3] AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
