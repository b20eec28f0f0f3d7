"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, fingerprints, langid, lines, nearcopies, packing, pieces, substring, toxicity
from .common import id_crc, prepare, read

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, removed_bytes, and the byte ranges removed."""
    prepare(spark)
    out = substring.substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", substring.removed_bytes().alias("removed_bytes"), "removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    held_out = (F.pmod(id_crc(), F.lit(4)) == 2).alias("held_out")
    model = langid.learn(docs.where(F.pmod(id_crc(), F.lit(4)) != 2), public_tokenizers.path(PIECES))
    return langid.identify(docs, model, also=[held_out]).select("doc_id", "held_out", "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.digests(pieces.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, and the numbers of the lines removed."""
    prepare(spark)
    return lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """A model learnt from labelled rows of docs outside the hold-out, whose crc32(doc_id) mod 3 is 1."""
    labels = read(spark, sf_dir, "labels").where(F.pmod(id_crc(), F.lit(3)) != 1)
    return toxicity.learn(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    held_out = (F.pmod(id_crc(), F.lit(3)) == 1).alias("held_out")
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir), [F.col("doc_id"), held_out])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the documents is the history; all rows are answered, the newer half through lookups."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    return exact.exact_dedup(docs, in_history=exact.older_half(docs)).drop("tie")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = fingerprints.neighbours(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.windows(with_probe(read(spark, sf_dir, "conversations"))))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearcopies.near_copies(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [op1_substring_dedup, op2_language_id, op3_sentencepiece, op4_line_dedup, op5_packing, op6_toxicity, op7_exact_dedup, op8_fingerprints, op9_chat_format, op10_minhash_near_dedup]
    return {f.__name__: f for f in names}


_EXACT = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
m AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, bool_or(doc_id <= low + (high - low) // 2) AS in_history_index FROM d, m GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, in_history_index, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

_CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
t AS (SELECT *, row_number() OVER w - 1 AS pos, (length(text) + 3) // 4 + 4 AS tokens, sum((length(text) + 3) // 4 + 4) OVER (w ROWS UNBOUNDED PRECEDING) AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
k AS (SELECT *, CASE WHEN (last - tokens) // {chat.SPAN} = (last - 1) // {chat.SPAN} THEN 2 * ((last - tokens) // {chat.SPAN}) ELSE 2 * ((last - 1) // {chat.SPAN}) - 1 END AS key, role = 'system' AND pos = 0 AS sys,
16 + length(text) + length(regexp_replace(text, '[^<\\\\]', '', 'g')) + length(role) + length(regexp_replace(role, '[^<>\\\\]', '', 'g')) AS size FROM t),
w AS (SELECT conv_id, key, min(pos) AS first_pos, max(last) AS upto, lead(key) OVER (PARTITION BY conv_id ORDER BY key) AS next_key FROM k GROUP BY conv_id, key),
again AS (SELECT k.conv_id, sum(k.size) AS chars FROM k JOIN w ON w.conv_id = k.conv_id AND w.key = k.key WHERE NOT sys AND next_key IS NOT NULL AND upto - last + tokens <= {chat.HISTORY} GROUP BY 1),
heads AS (SELECT k.conv_id, sum(k.size) AS chars FROM k JOIN w ON w.conv_id = k.conv_id AND w.first_pos > 0 WHERE sys GROUP BY 1),
o AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(size) AS chars FROM k GROUP BY conv_id)
SELECT o.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(o.chars + coalesce(again.chars, 0) + coalesce(heads.chars, 0) AS BIGINT) AS formatted_chars
FROM o LEFT JOIN again USING (conv_id) LEFT JOIN heads USING (conv_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the tests hold the others against brute force, round trips or held-out labels."""
    return {"op7_exact_dedup": _EXACT, "op9_chat_format": _CHAT}
