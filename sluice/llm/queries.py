"""The registered queries of the language-model operators, and their SQL where there is one."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import ann, html_render, imatch, mixing, near_dedup, packing, paragraph_dedup, pii, token_store, toxicity
from sluice.plans import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op2_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return html_render.extract(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours of every twentieth vector."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans of all documents."""
    return paragraph_dedup.repeats(_table(spark, sf_dir, "documents"))


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's key; where none is set, a public one for trials, under which surrogates protect nobody."""
    if spark.conf.get(pii.KEY_SETTING, None):
        return pii.key_of(spark)
    warnings.warn(f"{pii.KEY_SETTING} is not set: surrogates of this trial can be reversed", stacklevel=2)
    return b"a public key for trials"


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op9_orc_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ORC token ids, and the layout read back from the files."""
    at = scratch.path(spark, "tokens")
    token_store.write(_table(spark, sf_dir, "documents"), at, vocabulary())
    return token_store.index(spark, at)


QUERIES = {
    "op1_imatch": op1_imatch,
    "op2_html_render": op2_html_render,
    "op3_toxicity": op3_toxicity,
    "op4_multi_index": op4_multi_index,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_surrogates": op6_surrogates,
    "op7_weighted_mix": op7_weighted_mix,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_orc_token_store": op9_orc_token_store,
    "op10_minhash_forest": op10_minhash_forest,
}

ORACLES: dict[str, str] = {
    "op7_weighted_mix": mixing.oracle(),
    "op10_minhash_forest": near_dedup.oracle(),
}
