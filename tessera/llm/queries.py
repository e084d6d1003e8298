"""Queries over the operators of this subpackage, as registered by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, gif, katz, mixing, packing, quality, repeats, simhash, toxicity, urls
from .common import table


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), toxicity.Settings()
    known = toxicity.sample(docs, table(spark, sf_dir, "labels"), settings)
    model = toxicity.train([t for t, _, _ in known], [y for _, y, _ in known], [x for _, _, x in known], settings)
    return toxicity.score(docs, model)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; the vocabulary is read from there and never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_katz": op2_katz,
    "op3_extract": op3_extract,
    "op5_urls": op5_urls,
    "op7_pack": op7_pack,
    "op8_mix": op8_mix,
    "op9_gif": op9_gif,
    "op4_repeats": op4_repeats,
    "op6_compression_bands": op6_compression_bands,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op4_repeats": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w
    FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM docs WHERE len(ws) >= 13)
), firsts AS (
    SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w
), gone AS (
    SELECT DISTINCT doc_id, i + k AS pos
    FROM windows JOIN firsts USING (w), (SELECT unnest(generate_series(0, 12)) AS k)
    WHERE first_doc < doc_id
), words AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS left_words, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
""",
}
