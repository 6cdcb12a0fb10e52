"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import drop_stored, free_name, store, stored, table
from loomstone.llm.decontaminate import decontaminate, free_marker, remove_spans
from loomstone.llm.ngram_join import ngram_join
from loomstone.llm.packing import pack
from loomstone.llm.pii import find_pii, mask_pii
from loomstone.llm.quality import score, train
from loomstone.llm.tokens import token_counts


BASE = ("doc_id", "text", "lang", "source", "n_chars")  # columns of documents


def _apart(docs: DataFrame) -> DataFrame:
    """The columns of documents, and any others in one struct, where no operator's columns clash with them."""
    extra = [c for c in docs.columns if c not in BASE]
    return docs.select(*BASE, F.struct(*extra).alias("apart")) if extra else docs


def _back(out: DataFrame, columns: list[str]) -> DataFrame:
    return out.select(*[F.col(c) if c in BASE else F.col(f"apart.{c}") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers find good and not toxic.

    A null text is judged as an empty one, null metadata as a value of its own;
    repeated rows are judged alike. Without labels of both classes nothing goes.
    Columns beyond those of documents stay as they are.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return _back(score(_apart(docs), model).where("keep"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at 0.8: that with the smallest id.

    Rows that repeat this id are one document, of which the first row by source,
    language and text stays. Texts that are null, empty or without words, and rows
    with a null id, are in no group and stay. Other columns stay as they are.
    """
    groups = ngram_join(docs, k=5, num=80, den=100)
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct()
    twice = groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(dropped, "doc_id", "left_anti")
    same = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length(F.trim("text")) > 0), "source", "lang", "text")) == 1
    first = free_name(docs, "is_first")
    once = kept.join(twice, "doc_id", "left_semi").withColumn(first, same).where(first).select(docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: a mark that no item holds stands where a hit span was.

    Every row stays, also one whose whole text was cut; null and empty texts stay
    as they are, and so does everything where the benchmark is empty. ``n_chars``
    is counted again. Columns beyond those of documents stay as they are.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    cut = remove_spans(decontaminate(_apart(docs), benchmark), marker=free_marker(benchmark))
    return _back(cut.withColumn("n_chars", F.length("text").cast("bigint")), docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind.

    Every row stays; null and empty texts stay as they are, repeated rows are
    masked alike. ``n_chars`` is counted again. Columns beyond those of documents
    stay as they are.
    """
    masked = mask_pii(find_pii(_apart(docs)))
    return _back(masked.withColumn("n_chars", F.length("text").cast("bigint")), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, bucket, batch and slot.

    Null and empty texts have no tokens and take a slot too; repeated rows and
    null ids get slots of their own. Other columns go.
    """
    return pack(store(token_counts(docs.select("doc_id", "text")).select("doc_id", "n_tokens"), "lengths"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The classifier is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables that earlier stages have stored go as soon as the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    since = stored(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage{k}")
            drop_stored(spark, since, but_last=1)
    return docs
