"""Language identification by a convolutional network over bytes, in NumPy.

A window of bytes goes through filters of two, three and four bytes over byte
embeddings; the largest response of each filter feeds a softmax.  The network
is trained on the driver on all windows of a bounded sample of labelled texts.  For
prediction the embeddings are folded into the filters, so that a filter's
response is a sum of table rows: one row per byte pair or byte.  Every window of
a text is scored, and a text's score is the mean of its windows'.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C

WIDTHS = (2, 3, 4)
WINDOW = 128
#: The sample that is learned from: whole texts of at most so many bytes, so that the driver holds a bounded part of any corpus.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 16
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of fixed-length windows, document of each); the last window of a text is filled with spaces."""
    size = np.maximum(np.diff(offsets), 1)
    n = -(-size // window)
    doc = np.repeat(np.arange(len(size)), n)
    out = np.full((len(doc), window), 32, np.uint8)
    first = (np.cumsum(n) - n) * window
    flat = out.reshape(-1)
    flat[C.ragged_index(first, np.diff(offsets))] = data
    return out, doc


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, labels: list[str], embed: int = 8, filters: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, embed)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * embed), (w * embed, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (filters * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                grads = self._gradients(x[at], y[at])
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        embedded = p["e"][x]
        pooled, where, views = [], [], []
        for w in WIDTHS:
            view = np.concatenate([embedded[:, i : x.shape[1] - w + 1 + i] for i in range(w)], 2)
            z = view @ p[f"w{w}"]
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + p[f"b{w}"])
            where.append(at)
            views.append(view)
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        z = a @ p["o"] + p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        grads = {"o": a.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        back = (q @ p["o"].T) * (h > 0)
        size, embed = p["b2"].shape[0], p["e"].shape[1]
        for k, w in enumerate(WIDTHS):
            g = back[:, k * size : (k + 1) * size]
            picked = np.take_along_axis(views[k], where[k][:, :, None], 1)
            grads[f"w{w}"] = np.einsum("nfi,nf->if", picked, g)
            grads[f"b{w}"] = g.sum(0)
            to_view = g[:, :, None] * p[f"w{w}"].T[None]
            for i in range(w):
                bytes_ = x[np.arange(n)[:, None], where[k] + i]
                np.add.at(grads["e"], bytes_.reshape(-1), to_view[:, :, i * embed : (i + 1) * embed].reshape(-1, embed))
        return grads

    def folded(self) -> dict[str, np.ndarray]:
        """Filter responses as tables: of byte pairs (first two bytes, last two of four) and of single bytes (third of three)."""
        p, e = self.p, self.p["e"].shape[1]
        part = {w: [p["e"] @ p[f"w{w}"][i * e : (i + 1) * e] for i in range(w)] for w in WIDTHS}

        def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (b[:, None] + a[None]).reshape(65536, -1)  # a little-endian pair: the second byte is the high one

        first = np.concatenate([pairs(part[w][0], part[w][1]) for w in WIDTHS], 1)
        return {"first": first.astype(np.float32), "third": part[3][2].astype(np.float32), "last": pairs(part[4][2], part[4][3]).astype(np.float32), "bias": np.concatenate([p[f"b{w}"] for w in WIDTHS]), "o": p["o"], "c": p["c"]}


def scores(t: dict[str, np.ndarray], x: np.ndarray, block: int = 64) -> np.ndarray:
    """Softmax probabilities of windows."""
    n, size = x.shape
    f = t["third"].shape[1]
    out = np.empty((n, t["o"].shape[1]), np.float32)
    for i in range(0, n, block):
        own = np.ascontiguousarray(x[i : i + block])
        pair = own[:, :-1].astype(np.uint16) | (own[:, 1:].astype(np.uint16) << np.uint16(8))
        z = np.take(t["first"], pair, 0)
        two = z[:, :, :f].max(1)
        three = (z[:, : size - 2, f : 2 * f] + np.take(t["third"], own[:, 2:], 0)).max(1)
        four = (z[:, : size - 3, 2 * f :] + np.take(t["last"], pair[:, 2:], 0)).max(1)
        h = np.maximum(np.concatenate([two, three, four], 1) + t["bias"], 0)
        s = h @ t["o"] + t["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        out[i : i + block] = s / s.sum(1, keepdims=True)
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, window: int = WINDOW, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], dict[str, np.ndarray]]:
    """Labels and tables, learned from all windows of at most ``sample_rows`` texts of at most ``sample_bytes``, chosen by a hash of doc_id."""
    learn = docs.where("learn and lang is not null and text <> ''").where(F.octet_length("text") <= sample_bytes)
    mark = F.xxhash64("doc_id", F.lit(17))
    # Only hashes are sorted; the texts of the few rows chosen are read after that.
    last = learn.select(mark.alias("m")).orderBy("m").limit(sample_rows).agg(F.max("m").alias("m")).first()["m"]
    if last is None:
        return [], {}
    rows = learn.where(mark <= F.lit(last)).select("lang", "text", mark.alias("m")).orderBy("m", "text").limit(sample_rows).collect()
    labels = sorted({r["lang"] for r in rows})
    body = [r["text"].encode() for r in rows]
    x, doc = windows(np.frombuffer(b"".join(body), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in body])]), window)
    net = ByteNet(labels)
    net.fit(x, np.array([labels.index(r["lang"]) for r in rows])[doc], epochs=3)
    return labels, net.folded()


def language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, window: int = WINDOW) -> DataFrame:
    """doc_id, held_out, lang_pred and score (mean probability of the label over the text's windows) per row.

    Learns only from rows with a lang whose crc32(doc_id as text) mod 3 is not 1,
    at most ``sample_rows`` of them, of at most SAMPLE_BYTES each.  A text without a letter (null and empty
    ones, too) is ``und`` with score 0, and so is every text if there is nothing
    to learn from.  Rows may repeat; each is predicted by itself.  A null doc_id
    counts as the empty text in the checksum.  An empty table gives an empty result.
    """
    C.ship(docs.sparkSession)
    base = C.pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    base = base.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1)
    labels, tables = train(base.withColumn("learn", ~F.col("held_out")), sample_rows, window)
    buffer = io.BytesIO()
    np.savez(buffer, **tables)
    model = docs.sparkSession.sparkContext.broadcast(buffer.getvalue())  # 20 MB or less, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = dict(np.load(io.BytesIO(model.value))) if labels else {}
        names = np.array([*labels, UNKNOWN], object)
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(2))
            for i, j in C.slices(offsets, 4 << 20):
                n = j - i
                letters = batch.column(3).slice(i, n).to_numpy(zero_copy_only=False)
                best, score = np.full(n, len(labels)), np.zeros(n)
                if labels:
                    x, doc = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                    q = scores(t, x).astype(np.float64)
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    mean = np.add.reduceat(q, first) / np.diff(np.append(first, len(doc)))[:, None]
                    best = np.where(letters, mean.argmax(1), len(labels))
                    score = np.where(letters, np.clip(mean.max(1), 0, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return C.in_arrow(base.select("doc_id", "held_out", "text", F.col("text").rlike(r"\p{L}").alias("letters")), run, "doc_id long, held_out boolean, lang_pred string, score double")
