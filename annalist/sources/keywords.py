"""A keyword index in files: postings by bucket of term, built once and read by the terms of a query."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from annalist.functions.text import K1, LEAST_IDF, B, apart, counted, query_terms, runs, tokens, unpacked
from annalist.storage import read_bytes

#: A term in very many texts is written by this many tasks.
SALTS = 16


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class KeywordIndex:
    """term, fact, tf, dl of some texts, in folders by bucket of term and sorted by term within a file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        totals = spark.read.parquet(f"{path}/totals").first()
        self.n, self.mean, self.buckets = totals["n"], totals["mean"], totals["buckets"]
        self.postings = spark.read.schema("term string, fact long, tf long, dl int, head boolean, bucket int").parquet(f"{path}/postings")

    @staticmethod
    def build(facts: DataFrame, path: str, buckets: int | None = None) -> KeywordIndex:
        """Index the texts of (fact, text) under ``path``, in a bucket for every 64 MB that they are read from; null texts have no tokens."""
        spark = facts.sparkSession
        buckets = buckets or max(4, math.ceil(read_bytes(facts) / (64 << 20)))
        bucket = _bucket(F.coalesce("term", F.lit("")), buckets)
        facts = facts.select("fact", "text")
        # The only shuffle, into as many tasks as the input asks for; each row computes its bucket again behind it, which is not sent.
        if facts.schema["fact"].dataType == LongType() and apart(facts):
            dealt = unpacked(runs(facts, SALTS).repartition(buckets * SALTS, bucket, "salt"), facts)
        else:
            dealt = counted(facts).repartition(bucket, F.pmod(F.xxhash64("fact"), F.lit(SALTS)))
        dealt = dealt.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "fact")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        heads = spark.read.schema("dl int, head boolean").parquet(f"{path}/postings").where("head")
        heads.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return KeywordIndex(spark, path)

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms: only their buckets are read."""
        buckets = [r["b"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), self.buckets).alias("b")).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select("term", "fact", "tf", "dl")

    def bm25(self, query: str, texts: DataFrame | None = None) -> DataFrame:
        """fact and rank (the smaller, the better) of the texts with every word of ``query``.

        A word of several tokens is a phrase: the texts that have all its tokens
        are looked up in ``texts`` (fact, text) and read.
        """
        phrases = [list(p) for p in self.spark.range(1).select(query_terms(F.lit(query)).alias("q")).first()["q"] if p]
        if not phrases:
            return self.spark.createDataFrame([], "fact long, rank double")
        found: dict[tuple[str, ...], DataFrame] = {}
        for p in phrases:
            if tuple(p) in found:
                continue
            rows = self.of(list(dict.fromkeys(p)))
            if len(p) > 1:
                if texts is None:
                    raise ValueError("a phrase needs the texts")
                whole = rows.groupBy("fact").agg(F.count("*").alias("k"), F.first("dl").alias("dl")).where(F.col("k") == len(set(p)))
                ts = texts.join(whole, "fact").select("fact", "dl", tokens(F.col("text")).alias("ts"))
                at = F.sequence(F.lit(1), F.size("ts") - len(p) + 1)
                rows = ts.where(F.size("ts") >= len(p)).select("fact", F.size(F.filter(at, lambda i, p=p: F.slice("ts", i, len(p)) == F.array(*map(F.lit, p)))).cast("long").alias("tf"), "dl").where("tf > 0")
            found[tuple(p)] = rows.select("fact", "tf", "dl")
        names = {p: f"tf{i}" for i, p in enumerate(found)}
        joined = reduce(lambda a, b: a.join(b, "fact"), [rows.select("fact", F.col("tf").alias(names[p]), *(["dl"] if i == 0 else [])) for i, (p, rows) in enumerate(found.items())])
        counts = reduce(lambda a, b: a.crossJoin(b), [rows.agg(F.count("*").alias(f"df_{names[p]}")) for p, rows in found.items()])  # one row each
        rank = F.lit(0.0)
        for p in phrases:
            tf, df = F.col(names[tuple(p)]), F.col(f"df_{names[tuple(p)]}")
            idf = F.greatest(F.log((F.lit(self.n) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
            rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(self.mean)))
        return joined.crossJoin(F.broadcast(counts)).select("fact", rank.alias("rank"))
