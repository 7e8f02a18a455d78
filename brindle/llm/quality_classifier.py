"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and together cover all of it.
Learned filters of ``WIDTH`` bytes run over each chunk (a filter is a learned vector per byte value and offset);
activations are max-pooled over the chunk. Over the chunks of a text the pooled values are combined by their mean and
maximum, and one hidden layer makes them one probability that the text has label 1.

The network is fitted on the driver on a bounded sample: ``per_class`` labelled documents of each label (those with the
smallest hashes of their id and text among labelled documents not held out; equal rows are one), each with at most ``chunks_per_doc`` chunks spread evenly over
its whole text. These bounds are parameters and hold for fitting only: scoring reads every byte of every text.

Defined cases: a null or empty text is one chunk of zero bytes and is scored like any other. Labels other than 0 and 1,
and labels of unknown documents, are ignored; a label that is there twice counts once, two different labels once each, and
each text of an id has its label. Without rows of both labels the
score is the known label's, or 0.5 without any. Equal rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import Scratch, held_out, text_hash

CHUNK, OVERLAP, WIDTH, FILTERS, HIDDEN = 256, 32, 5, 24, 16
STEP = CHUNK - OVERLAP
#: The bytes that one chunk's filters see: CHUNK places, each with WIDTH bytes.
SPAN = CHUNK


def chunk_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - OVERLAP), STEP)


def cut(text: bytes) -> np.ndarray:
    """Chunks of a text as rows of SPAN byte values, padded with zeros at its end: a view, of the text's size."""
    raw = np.zeros(int(chunk_starts(len(text))[-1]) + SPAN, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(raw, SPAN)[::STEP]


@dataclass
class Net:
    table: np.ndarray  # WIDTH x 256 x FILTERS: the filters' weights for each byte value
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    constant: float | None = None

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Max-pooled activations of chunks (rows of bytes)."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for k in range(0, len(chunks), 256):
            part = chunks[k : k + 256]
            m = SPAN - WIDTH + 1
            act = self.table[0][part[:, :m]]
            for j in range(1, WIDTH):
                act += self.table[j][part[:, j : j + m]]
            out[k : k + 256] = act.max(axis=1)
        return np.maximum(out + self.bias, 0)

    def head(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        x = np.concatenate([mean, top], axis=1)
        h = np.maximum(x @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        cuts = [cut(t) for t in texts]
        begins = np.cumsum([0, *map(len, cuts)])[:-1]
        p = self.pooled(np.concatenate(cuts))
        counts = np.array([len(c) for c in cuts], np.float32)[:, None]
        return self.head(np.add.reduceat(p, begins, axis=0) / counts, np.maximum.reduceat(p, begins, axis=0)).astype(np.float64)


def loss_and_gradients(p: dict[str, np.ndarray], chunks: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy of documents of ``counts`` chunks each, and its gradient by each parameter."""
    begins = np.cumsum(np.concatenate([[0], counts]))[:-1]
    m = SPAN - WIDTH + 1
    act = p["table"][0][chunks[:, :m]]
    for j in range(1, WIDTH):
        act += p["table"][j][chunks[:, j : j + m]]
    at = act.argmax(axis=1)  # chunks x FILTERS
    best = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + p["bias"]
    pooled = np.maximum(best, 0)
    mean = np.add.reduceat(pooled, begins, axis=0) / counts[:, None]
    top = np.maximum.reduceat(pooled, begins, axis=0)
    x = np.concatenate([mean, top], axis=1)
    pre = x @ p["w1"] + p["b1"]
    h = np.maximum(pre, 0)
    out = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30)))
    g = (out - y) * weight / len(y)
    gh = np.outer(g, p["w2"]) * (pre > 0)
    gx = gh @ p["w1"].T
    doc = np.repeat(np.arange(len(y)), counts)
    gp = gx[doc, :FILTERS] / counts[doc, None] + gx[doc, FILTERS:] * (pooled == top[doc]) * (pooled > 0)
    gp = (gp * (best > 0)).astype(np.float32)
    gt = np.zeros_like(p["table"])
    rows, f = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
    for j in range(WIDTH):
        np.add.at(gt[j], (chunks[rows, at + j], np.broadcast_to(f, at.shape)), gp)
    loss = float(-(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).mean())
    return loss, {"table": gt, "bias": gp.sum(0), "w1": x.T @ gh, "b1": gh.sum(0), "w2": h.T @ g, "b2": np.array([g.sum()])}


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, min_steps: int = 400, rate: float = 0.01, batch: int = 32, seed: int = 0) -> Net:
    """texts: an array of chunks (rows of SPAN bytes) for each document. Small samples are gone through more often."""
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float64)
    if len(set(labels.tolist())) < 2:
        z = np.zeros
        return Net(z((WIDTH, 256, FILTERS), np.float32), z(FILTERS), z((2 * FILTERS, HIDDEN)), z(HIDDEN), z(HIDDEN), 0.0, float(y[0]) if len(y) else 0.5)
    p = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "b2": np.zeros(1),
    }
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    t = 0
    epochs = max(epochs, -(-min_steps * batch // max(1, len(texts))))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            ids = order[k : k + batch]
            counts = np.array([len(texts[i]) for i in ids])
            _, grads = loss_and_gradients(p, np.concatenate([texts[i] for i in ids]), counts, y[ids], weight[ids])
            t += 1
            for name, gr in grads.items():
                m1[name] = 0.9 * m1[name] + 0.1 * gr
                m2[name] = 0.999 * m2[name] + 0.001 * gr * gr
                p[name] -= (rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0) * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8)).astype(p[name].dtype)
    return Net(p["table"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


def _sampled_chunks(batches: Iterator[pa.RecordBatch], chunks_per_doc: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            all_chunks = cut((text or "").encode())
            some = np.unique(np.linspace(0, len(all_chunks) - 1, min(len(all_chunks), chunks_per_doc)).round().astype(int))
            out.append(all_chunks[some].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("_did"), b.column("_th"), pa.array(out, pa.binary())], names=["_did", "_th", "chunks"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 1_500,
    chunks_per_doc: int = 24,
    seed: int = 0,
) -> Net:
    """Fit on labelled rows that are not held out. At most 2 * per_class * chunks_per_doc * CHUNK bytes reach the driver."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("_did"), text_hash(text_col).alias("_th"), F.col(text_col).alias("text")).filter(F.col("_did").isNotNull())
    # A label that is there many times takes one place.
    found = texts.select("_did", "_th").distinct().join(known.distinct(), F.col("_did") == F.col("_lid")).select("_did", "_th", "label")
    found = Scratch(docs.sparkSession, "classifier").write(found, "labelled")
    order = [F.xxhash64("_did", "_th", F.lit(seed)), F.col("_did"), F.col("_th")]
    picked = [r for c in (0, 1) for r in found.filter(F.col("label") == c).orderBy(*order).limit(per_class).collect()]
    some = docs.sparkSession.createDataFrame(sorted({(r["_did"], r["_th"]) for r in picked}), found.select("_did", "_th").schema)
    rows = texts.join(F.broadcast(some), ["_did", "_th"], "left_semi")
    cuts = rows.mapInArrow(lambda b: _sampled_chunks(b, chunks_per_doc), T.StructType([*some.schema.fields, T.StructField("chunks", T.BinaryType())]))
    chunks = {(r["_did"], r["_th"]): bytes(r.chunks) for r in cuts.groupBy("_did", "_th").agg(F.min("chunks").alias("chunks")).collect()}
    got = sorted(((chunks[r["_did"], r["_th"]], r.label) for r in picked), key=lambda r: (r[1], r[0]))
    return fit([np.frombuffer(c, np.uint8).reshape(-1, SPAN) for c, _ in got], np.array([y for _, y in got]), seed=seed)


def _scores(model: Net, texts: pa.Array, batch_bytes: int) -> np.ndarray:
    scores, held, size = [np.zeros(0)], [], 0
    for value in texts:
        held.append((value.as_py() or "").encode())
        size += len(held[-1]) + CHUNK
        if size >= batch_bytes:
            scores.append(model.score(held))
            held, size = [], 0
    if held:
        scores.append(model.score(held))
    return np.concatenate(scores)


def keep(docs: DataFrame, net: Net, least: float = 0.7, text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """The rows of docs with a score of at least ``least``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column(text_col), batch_bytes) >= least))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """id_col and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(shared.value, b.column(1), batch_bytes))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
