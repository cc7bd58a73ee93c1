"""Nulls, empty tables, very long texts and clashing columns at the level of tables and stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annalist.llm import ctw, lines, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"word{i} of a text that is fine" for i in range(12))
ROWS = [(1, GOOD, "en", "a", 1), (1, GOOD, "en", "a", 1), (None, GOOD + " more", "en", None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n ", None, "b", 3), (None, None, None, None, None)]


def long_text():
    return "\n".join(f"line {i} of a very long text with some words" for i in range(60_000))


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_and_empty_tables(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = run(spark, docs, "")
    found = out.collect()
    if stage < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    want = {0: 2, 1: 7, 2: 5, 3: 7, 4: 7}[stage]
    assert len(found) == want, (name, found)
    assert run(spark, docs.limit(0), "").collect() == []


def test_near_duplicates_keep_one_of_each_and_all_without_words(spark):
    kept = corpus_pipeline.near(spark, spark.createDataFrame(ROWS, SCHEMA), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, x int").withColumnRenamed("x", "TEXT")


def test_scores_of_long_texts_and_clashing_columns(spark):
    rows = [(1, long_text()), (2, "line 5 of"), (3, None), (None, "a"), (10, "x")]
    got = {r.doc_id: r for r in ctw.ctw_score(clashing(spark, rows)).collect()}
    assert got[1].n_tokens == 600_001 and got[1].train_tokens == got[2].train_tokens and got[3].n_tokens == 1 and got[None].n_tokens == 2
    assert 0 < got[1].bits_per_byte < 3 and all(r.score < 0 for r in got.values())
    assert ctw.ctw_score(clashing(spark, rows).limit(0)).collect() == []


def test_lines_of_long_texts_and_clashing_columns(spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.line_dedup(clashing(spark, [(1, long_text()), (2, long_text() + "\nand one more line"), (3, "short\n" + "y" * 3_000_000)])).collect()}
    assert got == {1: (60_000, 0), 2: (60_001, 60_000), 3: (2, 0)}


def test_passages_of_long_texts(spark):
    got = {r.doc_id: (r.n_bytes - r.n_removed, r.n_spans) for r in suffix.suffix_dedup(clashing(spark, [(1, long_text()), (2, "zz" + long_text())])).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    n = len(long_text())
    assert got[1][0] + 0 > 0.1 * n and got[2] == (2, 1)


def test_keys_of_tables_larger_than_a_partition(spark):
    """Rows without a unique id get places in the order of (doc_id, text), whatever the partitions."""
    from annalist.llm import common as C

    docs = spark.range(300).select((F.col("id") % 50).alias("doc_id"), F.concat(F.lit("t"), F.lpad((F.col("id") * 7 % 300).cast("string"), 3, "0")).alias("text")).repartition(7)
    keyed = C.keyed(docs).orderBy("key").collect()
    assert [(r.doc_id, r.text) for r in keyed] == sorted((r.doc_id, r.text) for r in docs.collect()) and len({r.key for r in keyed}) == 300
