"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worklens.llm import align, bpe, decontaminate, lm, minhash, neighbours, phrases, pieces, quality, repeats, secrets, url_filter, warc

PIECES = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"), minhash.Settings(words=2)).drop("text_hash")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.evaluate(url_filter.dated_captures(pages), url_filter.intervals(url_filter.lists_from(pages)))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.sample(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ids=False)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.linked(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(PIECES))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_neighbours": op2_neighbours,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_minhash": op6_minhash,
    "op7_lm_score": op7_lm_score,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_sampled_pieces": op10_sampled_pieces,
    "op11_alignment": op11_alignment,
    "op12_repeats": op12_repeats,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op2_neighbours": neighbours.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op7_lm_score": lm.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op12_repeats": repeats.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
