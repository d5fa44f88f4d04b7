"""The registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, fim, jaccard, langid, licenses, media, mixing, packing, quality, sharding, tokenfiles, vectorcodes, warc
from .shared import partitions, take

#: The folder of public vocabulary files; a parameter of each operator that encodes text.
TOKENIZERS = os.environ.get("STRATALOOM_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, partitions(spark))
    return tokenfiles.read(manifest)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.scan(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_license_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_runs(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def remainder(of: int):
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = quality.learn(docs.filter(remainder(4) != 2), table(spark, sf_dir, "labels"))
    rated = quality.scores(docs, model)
    return rated.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = take(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = langid.learn(docs.filter(remainder(5) != 0), vocabulary("piece_bpe_32k.model"))
    return langid.predictions(docs.select("doc_id", "text"), model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(table(spark, sf_dir, "documents"), 8)
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", digest.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    rows = vectorcodes.with_label_errors(found.codes)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op4_license_scan": op4_license_scan,
    "op4_license_runs": op4_license_runs,
    "op5_media_columns": op5_media_columns,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language": op8_language,
    "op9_mix": op9_mix,
    "op10_pack": op10_pack,
    "op11_shards": op11_shards,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op4_license_scan": licenses.sql(),
    "op3_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k""",
    "op9_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k, row_number() OVER () AS row FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([5.0, 2.0, 1.0] AS DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS total, source_size * 2::DOUBLE AS cap FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM r
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, min(CASE WHEN cap * open <= weight * rest THEN 1 ELSE 0 END) OVER (ORDER BY place) AS filled FROM f),
t AS (SELECT source, source_size, CASE WHEN filled = 1 THEN cap ELSE weight * first(rest / open ORDER BY filled, place) OVER (PARTITION BY filled ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM u),
c AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, unnest(range(0, greatest(1, (size + 255) // 256))) AS packet FROM c CROSS JOIN (VALUES (0), (1)) AS v(copy)),
w AS (SELECT *, least(256, size - packet * 256) AS words FROM p),
o AS (SELECT *, CASE WHEN target > 0 THEN (start + copy * source_size + packet * 256 + words)::DOUBLE / target ELSE 'infinity'::DOUBLE END AS finish FROM w),
g AS (SELECT *, sum(words) OVER (ORDER BY finish, source NULLS LAST, k, doc_id, copy, packet ROWS UNBOUNDED PRECEDING) AS position, floor(sum(words) OVER () / 2 * 1.5 + 0.5) AS budget FROM o)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, sum(greatest(0, least(words, budget - position + words)))::BIGINT AS taken FROM g GROUP BY row""",
    "op12_vector_codes": vectorcodes.sql(),
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
n AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(u[1:least(h1, h2)], ''), '') AS p, coalesce(array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], ''), '') AS m, coalesce(array_to_string(u[greatest(h1, h2) + 1:], ''), '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
}
