"""Bounded hybrid search: keywords by BM25, vectors by cosine, fused by reciprocal rank, expanded over references."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.errors import QueryError, ValueTypeError
from annalist.functions.text import bm25
from annalist.functions.values import canonical_json
from annalist.sources.keywords import KeywordIndex
from annalist.storage import stored

#: The constant of reciprocal rank fusion and the bounds of results.
RRF_K, MOST_EXPANDED, MOST_FILTERS = 60, 100, 16
PULL_ATTRIBUTES, PULL_VALUES, MOST_BYTES = 32, 32, 1 << 20


def candidate_cap(k: int) -> int:
    if isinstance(k, bool) or not 1 <= k <= 100:
        raise ValueTypeError("k is 1 to 100")
    return min(500, max(50, 5 * k))


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine in double precision; null where lengths differ or a norm is zero."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / (norm * own))


def vector_candidates(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """fact, e, score of the best fact per entity among (fact, e, v), at most the cap; ties to the smaller fact."""
    if not query or not any(query):
        raise ValueTypeError("a query vector is not zero")
    scored = rows.select("fact", "e", cosine(F.col("v"), query).alias("score")).where("score IS NOT NULL")
    best = scored.groupBy("e").agg(F.max_by(F.struct("fact", "score"), F.struct("score", -F.col("fact"))).alias("x")).select("e", "x.fact", "x.score")
    return best.orderBy(F.desc("score"), "fact").limit(candidate_cap(k))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``rows`` (.., text) with v, the vector of each text, by a function of the caller that embeds a batch of texts; null texts have none."""
    from annalist.shipping import ship

    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = iter(embed([t for t in texts if t is not None]))
            yield pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return rows.withColumn("v", vectors("text"))


def keyword_candidates(rows: DataFrame, text: str, k: int, corpus: DataFrame | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """fact, e, rank of the best fact per entity among (fact, e, text).

    Statistics are those of ``corpus`` (fact, text), or of a keyword index of it,
    which is read in place of the texts.
    """
    corpus = corpus if corpus is not None else rows.select("fact", "text")
    ranked = (bm25(corpus, text) if index is None else index.bm25(text, corpus)).join(rows.select("fact", "e"), "fact")
    best = ranked.groupBy("e").agg(F.min(F.struct("rank", "fact")).alias("x")).select("e", "x.fact", "x.rank")
    return best.orderBy("rank", "fact").limit(candidate_cap(k))


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """e and score from candidate lists (e, name, place): the sum of 1 / (60 + place); ties by name."""
    every = reduce(DataFrame.unionByName, [x.select("e", "name", "place") for x in lists])
    return every.groupBy("e", "name").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("place"))).alias("score")).orderBy(F.desc("score"), "name").limit(k)


def placed(candidates: DataFrame, *order: Column) -> DataFrame:
    """Candidates (at most the cap) with their place from 1."""
    return candidates.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def filtered(entities: DataFrame, filters: list[DataFrame]) -> DataFrame:
    """Entities ``e`` that are in all of the filters' entity sets."""
    if len(filters) > MOST_FILTERS:
        raise QueryError("a search has at most 16 filters")
    return reduce(lambda out, f: out.join(f.select("e").distinct(), "e", "left_semi"), filters, entities)


def expand(edges: DataFrame, start: DataFrame, hops: int, most: int = MOST_EXPANDED) -> DataFrame:
    """e, hop and path (entities from a start) of what references reach, either way, in up to ``hops`` steps.

    Breadth first; of several ways to an entity the one over the smallest fact
    counts, and at most ``most`` entities are kept, nearest first.  ``edges``:
    fact, src, dst; ``start``: e.
    """
    if isinstance(hops, bool) or not 0 <= hops <= 3:
        raise ValueTypeError("expand is 0 to 3")
    both = edges.select("fact", F.col("src").alias("e"), F.col("dst").alias("to")).unionByName(edges.select("fact", F.col("dst").alias("e"), F.col("src").alias("to")))
    front = start.select("e", F.array("e").alias("path"))
    seen = start.select("e")
    out = None
    for hop in range(1, hops + 1):
        reached = both.join(front, "e").select(F.col("to").alias("e"), F.struct("fact", F.concat("path", F.array("to")).alias("path")).alias("way"))
        new = reached.join(seen, "e", "left_anti").groupBy("e").agg(F.min("way").alias("way"))
        new = stored(new.select("e", F.lit(hop).alias("hop"), F.col("way.path").alias("path"), F.col("way.fact").alias("fact")).orderBy("fact", "e").limit(most), "hop")
        out = new if out is None else out.unionByName(new)
        seen, front = seen.unionByName(new.select("e")), new.select("e", "path")
    if out is None:
        return start.select("e", F.lit(0).alias("hop"), F.array("e").alias("path")).where(F.lit(False))
    return out.orderBy("hop", "fact", "e").limit(most).select("e", "hop", "path")


def compact(rows: DataFrame) -> DataFrame:
    """Of (e, name, fact, j) the first 32 attributes by name, with the first 32 values of each."""
    by_value = Window.partitionBy("e", "name").orderBy("fact")
    by_name = Window.partitionBy("e").orderBy("name")
    kept = rows.withColumn("n", F.row_number().over(by_value)).where(F.col("n") <= PULL_VALUES)
    return kept.withColumn("m", F.dense_rank().over(by_name)).where(F.col("m") <= PULL_ATTRIBUTES).drop("n", "m")


def short(document: dict[str, Any]) -> dict[str, Any]:
    """The first 32 attributes by name, with the first 32 of many values."""
    return {k: v[:PULL_VALUES] if isinstance(v, list) else v for k, v in sorted(document.items())[:PULL_ATTRIBUTES]}


def bounded(result: dict[str, Any], most: int = MOST_BYTES) -> dict[str, Any]:
    """A result of at most ``most`` bytes: expanded entities go first, then evidence, then the last hits."""

    def fits() -> bool:
        return len(canonical_json(result).encode()) <= most

    while not fits():
        result["truncated"] = True
        if result["expanded"]:
            result["expanded"].pop()
        elif any(h["matched"] for h in result["hits"]):
            next(h for h in reversed(result["hits"]) if h["matched"])["matched"].pop()
        elif result["hits"]:
            result["hits"].pop()
        else:
            break
    return result


def check(text: Any, vector: Any, vector_attribute: Any, text_attributes: Any, filters: Any) -> None:
    """Reject a search without a signal, or with options that do not fit each other."""
    if text is None and vector is None:
        raise QueryError("a search needs text or a vector")
    if text is not None and not isinstance(text, str):
        raise ValueTypeError("search text is text")
    if (vector is None) != (vector_attribute is None):
        raise QueryError("a vector and its attribute come together")
    if text_attributes is not None and (not isinstance(text_attributes, list) or not 1 <= len(text_attributes) <= MOST_FILTERS):
        raise QueryError("a search names 1 to 16 text attributes")
    if filters and len(filters) > MOST_FILTERS:
        raise QueryError("a search has at most 16 filters")
