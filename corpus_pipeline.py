"""The corpus pipeline: quality rules, language, near duplicates, packing; each stage reads what the one before kept.

No SQL is given: language and packing aren't expressible; tests hold each stage against a brute-force version.

Stages read the five columns of documents and return them; other columns, whatever their names, are left out. Null or empty
texts don't reach the later stages, since the quality rules reject them (given to those stages alone: no language, no near
duplicate, a piece of one id). Repeated rows are judged alike by the first two stages, and near_duplicates keeps one of an
id; ties go by the smallest id, then text. Rows without id are rows like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import langid, minhash, packing, quality
from frameloom.llm.common import materialize
from frameloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_cascade(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter or a score of at least one half go. Trained as op4 is, on docs."""
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select(*COLUMNS), model, spans=False)
    return found.where("lang_pred <> 'und' AND score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Of rows that repeat that id the one with
    the smallest text stays (a null text is the smallest, then the other columns decide); rows without id all stay."""
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = docs.select(*COLUMNS).join(kept, "doc_id")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = found.where("n > 1").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("r")).select("doc_id", "r.*")
    return found.where("n = 1").select(*COLUMNS).unionByName(one.select(*COLUMNS)).unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences."""
    return packing.placements(packing.pack(docs, vocabulary("byte_bpe_50k.json"), slice_bytes=4 << 20, max_runs=500_000))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


