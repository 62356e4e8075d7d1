"""Documents to training tokens: language, near duplicates, benchmark passages, personal data, byte-level BPE.

A stage is a function of (spark, docs, sf_dir) that gets all that the stage before has kept. Each result is written as Parquet in the folder
that the cluster shares, and read again for the next stage. Of docs a stage needs doc_id, text and lang; n_chars is kept right where
there is one, and any other columns pass, whatever their names.

Empty tables stay empty. A null text has no language, so it goes in the first stage, as do empty texts and those without a letter.
Of repeated rows one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartweave.llm import bpe, decontaminate, langid, minhash, pii
from cartweave.llm.queries import TOKENIZER
from cartweave.llm.shared import bounded_batches, fresh_dir, remove, set_apart, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars is that of the text again."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null, or without a letter. The language found replaces a missing one; it is ``und`` if no
    row has a language to learn from."""
    bounded_batches(spark)
    docs, back = set_apart(docs, "doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~langid.held_out()))
    found = langid.predict(docs.where(F.col("text").rlike(r"\p{L}")), profiles)
    return back(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, and of its repeated rows one.

    Near duplicates are those with a Jaccard index of 0.80 or more, and what they link. Rows without doc_id all stay.
    """
    bounded_batches(spark)
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    docs, back = set_apart(docs, "doc_id", "text")
    stay = docs.join(gone, "doc_id", "left_anti")
    named = stay.where("doc_id is not null").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    return back(named).union(back(stay.where("doc_id is null")))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; of others the passages that a benchmark item has are cut out."""
    bounded_batches(spark)
    docs, back = set_apart(docs, "doc_id", "text", "n_chars")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return back(_counted(decontaminate.without_spans(found.where(~decontaminate.is_contaminated()))))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` and ``[CONTEXT]`` in place of what is found. Null and empty texts and repeated rows stay."""
    return _counted(pii.redacted(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; null and empty texts have no tokens, repeated rows each have a row."""
    bounded_batches(spark)
    return bpe.report(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, stable=True)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("personal data", redact_personal_data),
    ("byte-level BPE", encode_tokens),
]

#: SQL can't express the language profiles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table documents. A stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        to = fresh_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(to)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(to), to
    return STAGES[-1][1](spark, docs, sf_dir)
