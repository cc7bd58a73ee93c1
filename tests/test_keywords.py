"""Counts of terms and the keyword index: right on odd texts, and with no more shuffles than needed."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from annalist import registry
from annalist.functions import text
from annalist.functions.text import bm25, counted, postings, tokens
from annalist.sources.keywords import SALTS, KeywordIndex

ODD = [
    "the ered the", "THE Ered. the-ered,the", "", None, " \t\n..!", "Café cafe CAFÉ ́ ́x", "Über über über uber", "İstanbul Ǆ ΣΣ σς", "a b c​d\x00e a b",
    "\U0001d400\U0001d401 \U00020000 x \U0001f600the", "x1 2 ٣ Ⅻ 1_000", "中文 हिन्दी", "the " * 300 + "ered", "word" * 2000 + " the",
]


def exchanges(df: DataFrame) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def plainly(facts: DataFrame) -> list[tuple]:
    """Postings by an explosion of all tokens."""
    split = facts.select("fact", tokens(F.col("text")).alias("ts")).select("fact", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return sorted(map(tuple, split.groupBy("term", "fact").agg(F.count("*"), F.first("dl")).collect()))


@pytest.mark.parametrize("piece", [1, 40, 4 << 20])
def test_postings_of_odd_texts(spark, monkeypatch, piece):
    # Functions of a shipped module are read by the workers, so the piece is changed where they are called.
    count = text._count

    def smaller(batches):
        text._PIECE = piece
        yield from count(batches)

    monkeypatch.setattr(text, "_count", smaller)
    facts = spark.createDataFrame([(i * 7, t) for i, t in enumerate(ODD)], "fact long, text string")
    found = postings(facts)
    assert sorted(map(tuple, found.collect())) == plainly(facts)
    heads = {r.fact: (r.dl, r.term) for r in counted(facts).where("head").collect()}
    assert counted(facts).where("head").count() == len(heads) == len(ODD)
    assert [heads[7 * i] for i in (2, 3, 4)] == [(0, None)] * 3


def test_postings_move_no_rows(spark):
    facts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "fact long, text string")
    assert exchanges(postings(facts)) == 0


def test_an_empty_table_has_no_postings(spark):
    assert postings(spark.createDataFrame([], "fact long, text string")).collect() == []


def test_an_index_is_dealt_once(spark, tmp_path, monkeypatch):
    plans = {}
    real = DataFrameWriter.parquet

    def noted(self, path, *a, **b):
        plans[path.rsplit("/", 1)[1]] = exchanges(self._df)
        return real(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    facts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "fact long, text string")
    index = KeywordIndex.build(facts, f"{tmp_path}/index")
    assert plans["postings"] == 1
    known = facts.where("text IS NOT NULL")
    for query in ("the ered", "cafe", "uber", "the", "nothing"):
        index = KeywordIndex.build(known, f"{tmp_path}/{query}")
        found, wanted = ({r.fact: round(r["rank"], 12) for r in x.collect()} for x in (index.bm25(query), bm25(known, query)))
        assert found == wanted
    assert index.n == known.count()


def test_terms_of_repeated_documents(spark, tmp_path):
    rows = [(1, "a b a"), (1, "b c"), (2, "a"), (None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["postings_by_term"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("a", 2, 4), ("b", 1, 2), ("c", 1, 1)]


@pytest.mark.parametrize("name", ["bm25_rank", "hybrid_rrf"])
def test_queries_deal_their_index_once(spark, tmp_path, monkeypatch, name):
    at = tmp_path / name  # no index is kept for this path yet
    at.symlink_to("/root/testdata/sf0.001")
    plans = {}
    real = DataFrameWriter.parquet

    def noted(self, path, *a, **b):
        plans[path.rsplit("/", 1)[1]] = exchanges(self._df)
        return real(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    assert registry.QUERIES[name](spark, str(at)).count() > 0
    assert plans["postings"] == 1


@pytest.mark.parametrize("piece", [1, 40, 4 << 20])
def test_runs_hold_the_counted_rows(spark, monkeypatch, piece):
    pack, unpack = text._pack, text._unpack

    def smaller_pack(batches, salts):
        text._PIECE = piece
        yield from pack(batches, salts)

    def smaller_unpack(batches):
        text._PIECE = piece
        yield from unpack(batches)

    monkeypatch.setattr(text, "_pack", smaller_pack)
    monkeypatch.setattr(text, "_unpack", smaller_unpack)
    ids = [0, -1, 2**63 - 1, -(2**63), 7, 255, 256]
    facts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD, 1000)] + [(i, "the the b") for i in ids], "fact long, text string").coalesce(2)
    moved = text.runs(facts, 3).repartition(2, "term")
    found = text.unpacked(moved, facts)
    assert found.schema == counted(facts).schema
    assert set(found.collect()) == set(counted(facts).collect())
    assert found.count() == counted(facts).count()
    assert {r.salt for r in moved.collect()} <= {0, 1, 2}
    if piece > 40:
        assert moved.count() < found.count()


def test_the_tasks_of_an_index_grow_with_its_texts(spark, tmp_path, monkeypatch):
    """hybrid_rrf's index: rows of many postings are dealt, by the number of buckets and not by a session's number of partitions, beyond which tasks spill."""
    at = tmp_path / "tables"
    at.symlink_to("/root/testdata/sf0.001")
    plans = {}
    real = DataFrameWriter.parquet

    def noted(self, path, *a, **b):
        plans[path.rsplit("/", 1)[1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return real(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    registry.QUERIES["hybrid_rrf"](spark, str(at)).collect()
    exchange = next(x for x in plans["postings"].splitlines() if "Exchange " in x)
    assert f", {4 * SALTS}), REPARTITION_BY_NUM" in exchange
    assert "packed" in plans["postings"].split("Exchange ")[1]


def test_an_index_of_null_or_repeated_facts(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a"), (None, "a")], "fact long, text string")
    index = KeywordIndex.build(facts, f"{tmp_path}/index")
    assert sorted(map(tuple, index.of(["a", "b", "c"]).select("term", "fact", "tf").collect()), key=str) == [("a", 1, 2), ("a", 2, 1), ("a", None, 1), ("b", 1, 2), ("c", 1, 1)]
