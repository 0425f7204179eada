"""Queries of the operators in this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import (
    alignment,
    decontamination,
    jaccard,
    languages,
    licenses,
    lm,
    packing,
    pii,
    quality,
    repeats,
    resampling,
    sharding,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files lie; a cluster has them on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classify(table(spark, sf_dir, "documents")).drop("set_key", "class")


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)
    return pieces.drop("ids", "source")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that they hold; documents without any are not listed."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op11_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return alignment.link_counts(documents, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_language_id": op3_language_id,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_sampled_sharding": op11_sampled_sharding,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

# Remainders of the checksum's polynomial for every byte, as a list.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i::UBIGINT] || list_transform(range(8), lambda k: 0::UBIGINT),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) r(i))"""


def _crc32(digits: str) -> str:
    """Unsigned crc32 of bytes given as hex digits; ``crcs`` of crc_table is in scope."""
    high, low = (f"(instr('0123456789ABCDEF', {digits}[2 * k + {n}]) - 1)" for n in (1, 2))
    data = f"list_transform(range(strlen({digits}) // 2), lambda k: ({high} * 16 + {low})::UBIGINT)"
    step = "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255)::BIGINT + 1])"
    return f"xor(list_reduce([4294967295::UBIGINT] || {data}, {step}), 4294967295::UBIGINT)::BIGINT"


SQL: dict[str, str] = {
    "op11_sampled_sharding": f"""
WITH {_CRC_TABLE},
sums AS (
  SELECT text, {_crc32("digits")} AS text_crc32
  FROM (SELECT DISTINCT coalesce(text, '') AS text, hex(coalesce(text, '')) AS digits FROM documents), crc_table),
sized AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + {sharding.OVERHEAD} AS size FROM documents),
placed AS (
  SELECT *, row_number() OVER o AS place, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) * 2 - size AS middle, sum(size) OVER () AS total
  FROM sized WINDOW o AS (ORDER BY md5(text) NULLS FIRST, doc_id NULLS FIRST)),
sharded AS (
  SELECT *, least({sharding.SHARDS - 1}, {sharding.SHARDS} * middle // (2 * total))::INTEGER AS shard FROM placed)
SELECT s.doc_id, size::BIGINT AS size, c.text_crc32, 'bytes' AS law, shard,
  place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM sharded s JOIN sums c ON c.text = coalesce(s.text, '')""",
    "op13_importance_resampling": f"""
WITH {_CRC_TABLE},
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word
  FROM texts),
buckets AS (
  SELECT word, {_crc32("digits")} % {resampling.BUCKETS} AS bucket FROM (SELECT DISTINCT word, hex(word) AS digits FROM words), crc_table),
features AS (SELECT side, row, bucket FROM words JOIN buckets USING (word)),
sums AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE + {resampling.BUCKETS} AS all_s, coalesce(sum(t), 0)::DOUBLE + {resampling.BUCKETS} AS all_t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * all_s / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain FROM sums, totals),
weights AS (
  SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, row, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, row) AS place, count(*) OVER () AS able
  FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * able // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row)""",
}
