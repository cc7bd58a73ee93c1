"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import common as C
from annalist.llm.jaccard import near_duplicates
from annalist.llm.lines import dedup_lines
from annalist.llm.packing import pack
from annalist.llm.quality import quality_filter
from annalist.llm.queries import tokenizer_path
from annalist.llm.suffix import dedup_passages

_left: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the one before it wrote on its way, since its result is in ``docs`` by now; what ``docs`` itself reads stays."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        done = [p for p in _left if not any(p.rsplit("/", 1)[1] in f for f in files)]
        C.dropped(spark, *done)
        before = set(C.made)
        out = work(spark, docs, sf_dir)
        _left[:] = [p for p in _left if p not in done] + [p for p in C.made if p not in before]
        return out

    return run_stage


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, with those of condemned hosts."""
    return quality_filter(C.pick(docs, *COLUMNS))


def _with_text(base: DataFrame, texts: DataFrame) -> DataFrame:
    """The columns of ``documents`` with new texts, by key; n_chars is counted again."""
    rest = base.select("key", "doc_id", "lang", "source")
    return rest.join(texts, "key").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id has go; every document stays."""
    base = C.keyed(docs, carry=REST)
    return _with_text(base, dedup_lines(base).select("key", "text"))


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    base = C.keyed(docs, carry=REST)
    first = near_duplicates(base).where("key = class_key").select("key")
    return base.join(first, "key", "left_semi").select(*COLUMNS)


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that start earlier in the table go, by whole characters; every document stays."""
    base = C.keyed(docs, carry=REST)
    return _with_text(base, dedup_passages(base, whole_characters=True).select("key", F.col("kept").cast("string").alias("text")))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    out = pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("jaccard_join", near), ("suffix_dedup", passages), ("packing", packed)]

#: The ids of the last stage are not to be had in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is written to the shared folder and read again.

    A result goes once the next one is written, and what a stage wrote on its way when the next one begins.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = C.stored(docs, name)
            C.dropped(spark, *before)
            before = [path]
    return docs
