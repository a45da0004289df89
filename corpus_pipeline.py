"""The pipeline for a training corpus: language, toxicity, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
documents. Null texts: the language stage rejects them, for they have no letter.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secondlook.llm import chosen_path, harmonic_packing, language, skip_chain, toxicity
from secondlook.llm.common import table
from secondlook.operators.skew import free_name
from secondlook.session import fresh_path, stage

#: A text goes if no language holds this share of its letters, or if it has no letter.
LEAST_LANGUAGE_SHARE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = free_name("_language", docs)
    found = language.with_language(docs, language.train(docs), out=new, spans=False)
    known = F.col(f"{new}.lang") != language.UNKNOWN
    return found.filter(known & (F.col(f"{new}.score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    new = free_name("_toxicity", docs)
    found = toxicity.with_toxicity(docs, model, out=new)
    return found.filter(F.col(new) < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows that share this id, one.

    Rows that share an id but no likeness belong to groups of their own. Rows without an id all stay.
    """
    found = stage(chosen_path.marked_rows(docs).select("doc_id", "text_key", "stays"), "stays")
    id_key, text_key = free_name("_id", docs), free_name("_text", docs)
    keys = [id_key, text_key]
    named = found.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_key), F.col("text_key").alias(text_key), "stays")
    copies = named.filter(~F.col("stays")).select(*keys).distinct()
    kept = docs.withColumns({id_key: F.col("doc_id").cast("long"), text_key: chosen_path.text_key()})
    kept = kept.join(copies, keys, "left_anti")
    # The row that stays may stand in the table more than once.
    repeated = named.filter("stays").groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if not repeated.isEmpty():
        once = kept.join(repeated, keys, "left_semi").dropDuplicates(keys)
        kept = kept.join(repeated, keys, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind."""
    new = free_name("_personal", docs)
    found = skip_chain.with_personal_data(docs, skip_chain.train(docs), out=new)
    masked = {"text": F.col(f"{new}.masked"), "n_chars": F.char_length(F.col(f"{new}.masked")).cast("long")}
    return found.withColumns({k: v for k, v in masked.items() if k in docs.columns}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: The stages learn models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
