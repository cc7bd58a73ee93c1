"""Quality rules per document and per host, in DataFrame functions only.

Rules mark single documents.  A host (``source``) whose documents fail too often
is marked as a whole: the failures are counted by host, each host's rate is
shrunk toward the mean of all hosts by a beta prior fitted to the hosts'
rates (method of moments), and the verdict on the host is joined back to its
documents.  A host with few documents stays near the mean, so it takes evidence
to condemn one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C

#: Characters that words never hold.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Host verdicts of up to so many bytes (names and 64 bytes each) are broadcast; more are joined by a salted shuffle.
BROADCAST_BYTES = 4 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word window found twice or more in ``words``.

    Windows are compared by a 64-bit hash.  Only where a hash repeats are the
    windows sorted; each repeated window then adds the words that the next
    repeated one does not cover.
    """
    n = F.size(words)
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(p) - 1),
                        lambda k: ((k > 0) & (F.get(p, k - 1)["h"] == F.get(p, k)["h"])) | ((k < F.size(p) - 1) & (F.get(p, k + 1)["h"] == F.get(p, k)["h"])),
                    ),
                    lambda k: F.get(p, k)["i"],
                )
            ),
        )
        return let(again, lambda a: F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(a, k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda s, x: s + x))

    return let(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("long")).otherwise(covered(h)))


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text without nulls."""
    solid = F.translate(text, SPACE, "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return {
        "counted": found,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures, base_failed and rule_failed (that, or a softer sign of junk) per row."""
    base = C.pick(docs, "doc_id", "text", "source").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *(c.alias(k) for k, c in measures(F.col("text")).items()))
    out = out.select("doc_id", "source", F.col("counted.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("counted.n_repeat_words").alias("n_repeat_words"))
    return _judged_alone(out)


def _judged_alone(rows: DataFrame, prefix: str | None = None) -> DataFrame:
    """``rows`` with base_failed and rule_failed, by the measures as columns or, with a prefix, as ``measures`` names them."""
    n_words, n_repeat = ("n_words", "n_repeat_words") if prefix is None else (f"{prefix}counted.n_words", f"{prefix}counted.n_repeat_words")
    n, symbols, chars = F.col(n_words), F.col(f"{prefix or ''}n_symbols"), F.col(f"{prefix or ''}word_chars")
    failed = (n < 20) | (100 * F.col(n_repeat) > 30 * n)
    soft = (10 * symbols > n) | (chars > 12 * n) | (chars < 2 * n)
    return rows.withColumn("base_failed", failed).withColumn("rule_failed", failed | soft)


def host_verdicts(rules: DataFrame, most: float = 0.5) -> DataFrame:
    """source, n_docs, n_failed, rate (shrunk) and bad per host; documents without a host are a host of their own."""
    hosts = rules.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    # Moments over hosts; the part of the variance that small hosts have by chance is taken off.
    fit = hosts.agg(F.avg(raw).alias("m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("u"))
    m = F.least(F.greatest(F.col("m"), F.lit(1e-3)), F.lit(1 - 1e-3))
    spread = m * (1 - m)
    within = spread * F.col("u")
    between = F.greatest(F.col("v") - within, spread * 1e-3)
    strength = F.greatest(spread / between - 1, F.lit(1.0))
    prior = fit.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    return hosts.join(F.broadcast(prior)).select("source", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > most).alias("bad"))  # the prior is one row


def judged(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` with source, and the columns rate and bad of its host."""
    own = hosts.select(F.col("source").alias("__host"), "rate", "bad")
    size = hosts.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(own), rows["source"].eqNullSafe(own["__host"]), "left").drop("__host")
    salts = F.lit(64)
    own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = rows.withColumn("__dealt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    return dealt.join(own, dealt["source"].eqNullSafe(own["__host"]) & (dealt["__dealt"] == own["__salt"]), "left").drop("__host", "__salt", "__dealt")


def quality(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """doc_id, source, the measures, base_failed, host_rate and kept per row of ``docs``.

    kept is false where base_failed, and where the shrunk rate of failures of the
    document's host is over ``most``.  Null text has no words.  Rows without a
    source share one host.  Rows may repeat; each counts.  An empty table gives
    an empty result.
    """
    rules, _ = C.stored(measured(docs), "rules")
    hosts, _ = C.stored(host_verdicts(rules, most), "hosts")
    return judged(rules, hosts).select("doc_id", "source", *MEASURES, "base_failed", F.col("rate").alias("host_rate"), (~F.col("base_failed") & ~F.coalesce("bad", F.lit(False))).alias("kept"))


def quality_filter(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.

    Each text is measured once: rows are written with their verdict, and the
    hosts' verdicts join them from there.
    """
    columns = docs.columns
    m = measures(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _judged_alone(docs.select(*columns, *(c.alias(f"__{k}") for k, c in m.items())), "__").select(*columns, "base_failed", "rule_failed")
    rows, _ = C.stored(rows.withColumn("source", F.col("source").cast("string")), "rules")
    hosts, _ = C.stored(host_verdicts(rows, most), "hosts")
    return judged(rows.where("NOT base_failed"), hosts).where(~F.coalesce("bad", F.lit(False))).select(*columns)
