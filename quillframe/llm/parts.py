"""What SQL can say of operators that it can't express as a whole: some of their columns, and facts of their results.

Each query runs its operator's own query over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm import catalog, near_dup, repeats
from quillframe.llm.common import table, unwrap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def part(name: str, sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> None:
        QUERIES[name], ORACLE[name] = f, sql

    return put


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: crc32 of a short ASCII text: each byte is xored in and followed by eight shifts (-1 in the list).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({of}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295::BIGINT)"""


def _crc(of: str) -> str:
    return _CRC.format(of=of)


@part("part_op1_decoded", "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents")
def _(spark, d):
    return catalog.op1_bpe(spark, d).select("doc_id", "decoded_sha256")


@part("part_op2_base", rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 2], ' ') AS told FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS s FROM docs)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, told) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM again CROSS JOIN range(3) AS r(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
counted AS (
    SELECT docs.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN covered ON docs.doc_id = covered.doc_id LEFT JOIN lines ON docs.doc_id = lines.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
""")
def _(spark, d):
    return catalog.op2_quality_rules(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@part("part_op4_base", rf"""
WITH docs AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_append({_WORDS.replace("text,", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")}, chr(10)) AS ws FROM documents),
words AS (SELECT doc_id, held_out, word, count(*) AS times FROM (SELECT doc_id, held_out, unnest(ws) AS word FROM docs) GROUP BY ALL),
counts AS (SELECT word, sum(times) AS c FROM words WHERE NOT held_out GROUP BY 1),
total AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, sum(times)::BIGINT AS n_tokens, coalesce(sum(CASE WHEN c > 0 THEN times END), 0)::BIGINT AS n_known, max(n)::BIGINT AS train_tokens,
    round(sum(times * log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) AS base_score
FROM words LEFT JOIN counts USING (word) CROSS JOIN total GROUP BY 1, 2
""")
def _(spark, d):
    return catalog.op4_lm_scoring(spark, d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


@part("part_op5_texts", """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC) AS k FROM documents),
placed AS (SELECT *, coalesce(lead(text) OVER (ORDER BY k), first_value(text) OVER (ORDER BY k)) AS next FROM docs)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substring(text, 1, (n - n // 3)::BIGINT) || substring(next, 1, (n // 3)::BIGINT)) AS edited_sha256 FROM placed
""")
def _(spark, d):
    return catalog.op5_document_fingerprints(spark, d).select("doc_id", "n_chars", "edited_sha256")


@part("part_op8_places", "SELECT doc_id, 0::BIGINT AS faults FROM documents")
def _(spark, d):
    """Pieces of a document that don't begin where the last one ended, overfill their sequence, or leave a gap in it."""
    pieces = catalog.op8_best_fit_packing(spark, d)
    of_doc, of_sequence = Window.partitionBy("doc_id").orderBy("piece"), Window.partitionBy("sequence_id").orderBy("offset")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fault = (
        (F.col("start") != before("length", of_doc)) | (F.col("piece") != F.row_number().over(of_doc) - 1) | (F.col("offset") != before("length", of_sequence))
        | (F.col("offset") + F.col("length") > 2048) | (F.col("length") < 1) | ((F.col("piece") > 0) & (F.col("length") != 2048)))
    return pieces.withColumn("fault", fault.cast("long")).groupBy("doc_id").agg(F.sum("fault").alias("faults"))


@part("part_op9_unknown", rf"SELECT doc_id, {_crc('doc_id::VARCHAR')} % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS unknown FROM documents")
def _(spark, d):
    return catalog.op9_language_id(spark, d).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("unknown"))


@part("part_op10_sizes", "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, 'bytes' AS law, NULL::INTEGER AS grown_shard FROM documents")
def _(spark, d):
    return catalog.op10_sharding(spark, d).select("doc_id", "size", "law", "grown_shard")


@part("part_op10_balance", "SELECT k::INTEGER AS shard, 0::BIGINT AS first_slot, true AS gapless, true AS balanced FROM range(16) AS t(k)")
def _(spark, d):
    """Shards are balanced if none is off the mean by more than 2 % and the largest record."""
    placed = catalog.op10_sharding(spark, d).groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.count(F.lit(1)).alias("rows"))
    mean, largest = (f("bytes").over(Window.partitionBy()) if f is F.avg else f("largest").over(Window.partitionBy()) for f in (F.avg, F.max))  # of 16 rows
    return placed.select("shard", "first_slot", ((F.col("slots") == F.col("rows")) & (F.col("last") == F.col("rows") - 1)).alias("gapless"), (F.abs(F.col("bytes") - mean) <= 0.02 * mean + largest).alias("balanced"))


@part("part_pipeline_near_duplicates", f"SELECT doc_id FROM ({catalog._NEAR_SQL}) WHERE kept")
def _(spark, d):
    """The third stage of the pipeline, on the whole table."""
    return near_dup.keep_one(table(spark, d, "documents")).select("doc_id")


@part("part_pipeline_substring_dedup", f"SELECT doc_id, CASE WHEN n_removed = 0 THEN sha256(text) ELSE kept_sha256 END AS text_sha256 FROM ({catalog._REPEATS_SQL}) JOIN documents USING (doc_id) WHERE n_words > n_removed")
def _(spark, d):
    """The fourth stage of the pipeline, on the whole table."""
    docs = table(spark, d, "documents")
    rows = repeats.remove_repeats(docs, layout=True).filter(F.col("n_words") > F.col("n_removed"))
    return unwrap(rows, docs.columns, text="kept_text").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
