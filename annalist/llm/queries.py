"""The queries of the corpus operators: each applies one to its whole table and returns what its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.bpe import bpe_encode, frequent_words
from annalist.llm.ctw import ctw_score
from annalist.llm.html import extract
from annalist.llm.jaccard import jaccard_join
from annalist.llm.langid import language
from annalist.llm.lines import line_dedup
from annalist.llm.packing import pack
from annalist.llm.quality import MEASURES, quality
from annalist.llm.suffix import suffix_dedup
from annalist.llm.topk import quantised, top_k


def tokenizer_path() -> str:
    """The public word-level BPE vocabulary of this installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(_table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(_table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = bpe_encode(docs, tokenizer_path(), frequent_words(docs))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_html": op3_html,
    "op4_host_quality": op4_host_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_language": op6_language,
    "op7_pack": op7_pack,
    "op8_top_k": op8_top_k,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: Where SQL expresses the contract at a bearable cost on whole tables.
ORACLES: dict[str, str] = {
    "op4_host_quality": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        win AS (SELECT r, u.i AS i, u.w AS g FROM (SELECT r, unnest(list_transform(range(1, len(ws) - 6), lambda i: {'i': i, 'w': ws[i:i + 7]})) AS u FROM w WHERE len(ws) >= 8)),
        rep AS (SELECT r, unnest(i_s) AS i FROM (SELECT r, g, list(i) AS i_s FROM win GROUP BY r, g HAVING count(*) > 1)),
        cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, range(8) AS x(o) GROUP BY r),
        m AS (SELECT w.r, doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                     coalesce(cov.n, 0) AS n_repeat_words
              FROM w LEFT JOIN cov ON w.r = cov.r),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
        f AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR word_chars > 12 * n_words OR word_chars < 2 * n_words AS failed FROM b),
        h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM f GROUP BY source),
        p AS (SELECT least(greatest(avg(k / n), 1e-3), 1 - 1e-3) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS u FROM h),
        q AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * u, m * (1 - m) * 1e-3) - 1, 1) AS s FROM p),
        x AS (SELECT source, (k + m * s) / (n + s) > 0.5 AS bad FROM h, q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT x.bad AS kept
        FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
    """,
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, u.i AS i, u.s AS s, translate(regexp_replace(regexp_replace(u.s, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda x, i: {'i': i, 's': x})) AS u FROM d)),
        m AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k),
        j AS (SELECT l.doc_id, l.i, l.s, m.first IS NOT NULL AND l.doc_id <> m.first AS gone FROM l LEFT JOIN m ON l.k = m.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op8_top_k": r"""
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
