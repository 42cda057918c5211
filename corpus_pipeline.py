"""The corpus pipeline: STAGES applied one after the other to ``documents``.

Every stage works on all rows that the one before it kept, and all but the last return the columns of ``documents``; further columns
are left out, whatever their names. A stage that gets no rows gives none. Null ids, texts and other values pass through each
stage but where it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specdag.llm.common import discard, materialize, read, remainder

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: Fixed value: a document is rejected if its quality score is lower.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive quality classifier does not reject: those of a score of LEAST_QUALITY or more.

    Null and empty texts have the score of a text without words, and go if that is lower. Repeated rows stay or go together. Without
    labels every document has a score of one half and stays."""
    from specdag.llm.quality_gam import classify, fit

    model = fit(docs, read(spark, sf_dir, "labels"), lambda i: remainder(i, 5) == 0)
    return classify(docs, model, columns=DOCUMENTS).filter(F.col("score") >= LEAST_QUALITY).select(*DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates over five-word shingles the document of least id; rows without an id stay.

    Null and empty texts are near no other text. Of rows that share an id one stays, that of the greatest text; of equal ones any."""
    from specdag.llm.near_dup import checked_join, near_duplicates

    docs = docs.select(*DOCUMENTS)
    groups = materialize(near_duplicates(docs, width=5, percent=80).filter("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    kept = checked_join(docs, groups, "doc_id", "left_anti").select(*DOCUMENTS)
    repeated = materialize(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    if not repeated.limit(1).count():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(F.desc_nulls_last(c) for c in DOCUMENTS)))
    once = checked_join(kept, repeated, "doc_id", "left_semi").select(*DOCUMENTS, first.alias("_first")).filter("_first = 1").select(*DOCUMENTS)
    return checked_join(kept, repeated, "doc_id", "left_anti").select(*DOCUMENTS).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; repeated rows stay or go together; an empty
    benchmark removes nothing."""
    from specdag.llm.decontamination import remove_leaks

    return remove_leaks(docs.select(*DOCUMENTS), read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind; where any is, ``n_chars`` is that of the new text. Null texts stay
    null and empty ones empty; repeated rows are treated each by itself."""
    from specdag.llm.pii import pii_spans, redact

    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*DOCUMENTS).withColumn("_spans", pii_spans(text))
    clean = found.withColumn("text", F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col("_spans"))))
    return clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their token ids. Null and empty texts are one piece, the end id; repeated rows are packed
    each by itself; null ids stay null."""
    import public_tokenizers

    from specdag.llm.packing import pack

    files = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), **files)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]
#: Learned and tokenizing stages cannot be stated in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            discard(last)
    return docs
