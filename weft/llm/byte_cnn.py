"""Language identification with a convolutional network over bytes.

A window of WINDOW bytes goes through a byte embedding, filters of several widths, a rectifier, the maximum over the
window and a softmax. Training is plain numpy on a bounded sample of labelled windows; a document's languages are the
softmax outputs of all its windows, averaged by their bytes, so every byte of a text counts once.

For prediction, embedding and filters are folded into tables: what a pair of bytes adds to each filter is one row of a
table with 65,536 rows, so a filter of width four is two look-ups and one addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._common import bound_batches, quoted, slices, table, utf8

WINDOW, EMBEDDING, FILTERS, WIDTHS = 192, 8, 16, (2, 3, 4)
#: Training windows: at most about this many for each language, one to four from a document, at places that follow from a hash.
WINDOWS_PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 1500, 4
EPOCHS, BATCH, RATE = 6, 64, 4e-3
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # width x EMBEDDING x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _padded(data: np.ndarray, window: int) -> np.ndarray:
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, window)


def _forward(m: Model, x: np.ndarray):
    e = m.embedding[x]
    pooled, where, unfolded = [], [], []
    for w, f in zip(WIDTHS, m.filters, strict=True):
        steps = x.shape[1] - w + 1
        u = np.concatenate([e[:, j : j + steps] for j in range(w)], axis=2)
        z = u @ f.reshape(w * EMBEDDING, FILTERS)
        i = z.argmax(axis=1)
        pooled.append(np.take_along_axis(z, i[:, None], 1)[:, 0])
        where.append(i)
        unfolded.append(u)
    h = np.concatenate(pooled, axis=1) + m.bias
    r = np.maximum(h, 0)
    s = r @ m.out + m.out_bias
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), r, h, where, unfolded


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on windows (n x WINDOW bytes) and label numbers, classes weighted to equal shares."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    m = Model(languages, rng.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32), [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(np.float32), np.zeros(k, np.float32))
    params = [m.embedding, *m.filters, m.bias, m.out, m.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(labels, minlength=k)
    weight = (len(labels) / (max(1, (share > 0).sum()) * np.maximum(share, 1))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            x, y = windows[order[a : a + BATCH]], labels[order[a : a + BATCH]]
            p, r, h, where, unfolded = _forward(m, x)
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            d *= weight[y][:, None] / len(y)
            grads_out, grads_ob = r.T @ d, d.sum(axis=0)
            dh = (d @ m.out.T) * (h > 0)
            ge, gf = np.zeros_like(m.embedding), []
            for c, (w, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
                g, i = dh[:, c * FILTERS : (c + 1) * FILTERS], where[c]
                rows = unfolded[c][np.arange(len(y))[:, None], i]  # n x FILTERS x (w * EMBEDDING)
                gf.append(np.einsum("nfe,nf->ef", rows, g).reshape(w, EMBEDDING, FILTERS))
                for j in range(w):
                    np.add.at(ge, x[np.arange(len(y))[:, None], i + j], g[:, :, None] * f[j].T[None])
            grads = [ge, *gf, dh.sum(axis=0), grads_out, grads_ob]
            t += 1
            for q, g, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return m


class Predictor:
    """A model folded into look-up tables."""

    def __init__(self, m: Model):
        self.model = m
        one = [[m.embedding @ f[j] for j in range(w)] for w, f in zip(WIDTHS, m.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.first = np.ascontiguousarray(np.concatenate([pair(t[0], t[1]) for t in one], axis=1), np.float32)
        self.third = np.ascontiguousarray(one[1][2], np.float32)
        self.second = np.ascontiguousarray(pair(one[2][2], one[2][3]), np.float32)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Places come first in memory, so rows are added and compared whole, and the maximum runs over long rows."""
        width = x.shape[1]
        low = np.ascontiguousarray(x.T)
        pairs = (low[:-1].astype(np.intp) << 8) | low[1:]
        z = np.take(self.first, pairs, axis=0, mode="clip")
        z[: width - 2, :, FILTERS : 2 * FILTERS] += np.take(self.third, low[2:], axis=0, mode="clip")
        z[: width - 3, :, 2 * FILTERS :] += np.take(self.second, pairs[2:], axis=0, mode="clip")
        # a filter of width w ends w - 1 places before the window does
        out = z[: width - 3].max(axis=0)
        for c, w in enumerate(WIDTHS[:-1]):
            part = slice(c * FILTERS, (c + 1) * FILTERS)
            out[:, part] = np.maximum(out[:, part], z[width - 3 : width - w + 1, :, part].max(axis=0))
        return out

    def windows(self, x: np.ndarray) -> np.ndarray:
        m, parts = self.model, []
        for a in range(0, len(x), 256):
            s = np.maximum(self.pooled(x[a : a + 256]) + m.bias, 0) @ m.out + m.out_bias
            p = np.exp(s - s.max(axis=1, keepdims=True))
            parts.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """One row of language probabilities for each non-empty text; a long text is read piece by piece."""
        out = np.zeros((len(texts), len(self.model.languages)))
        step = 1024 * WINDOW
        pieces = [(i, a, min(len(t), a + step)) for i, t in enumerate(texts) for a in range(0, max(1, len(t)), step)]
        for lo, hi in slices([b - a for _, a, b in pieces], step):
            part = [(i, _padded(np.frombuffer(texts[i], np.uint8, b - a, a) if b > a else np.zeros(0, np.uint8), WINDOW), b - a) for i, a, b in pieces[lo:hi]]
            p = self.windows(np.concatenate([x for _, x, _ in part]))
            at = 0
            for i, x, n in part:
                size = np.full(len(x), WINDOW, np.float64)
                size[-1] = n - WINDOW * (len(x) - 1) or 1
                out[i] += size @ p[at : at + len(x)]
                at += len(x)
        return out / np.maximum(1, np.array([len(t) or 1 for t in texts]))[:, None]


def training_windows(df: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = WINDOWS_PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of labelled windows.

    Documents are taken by a hash of their id, as many of each label as are expected to give ``per_label`` windows, and
    windows start at hashed places anywhere in the text. At most twice ``per_label`` windows of a label arrive here.
    """
    usable = df.select(F.col(id_col).cast("string").alias("i"), utf8(F.col(text_col)).alias("b"), F.col(label_col).cast("string").alias("y")).filter("y is not null and b is not null")
    counts = {r["y"]: r["n"] for r in df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    documents = max(1, per_label // WINDOWS_PER_DOCUMENT)
    share = F.create_map(*[F.lit(x) for y in labels for x in (y, min(1.0, documents / counts[y]))])
    draw = F.pmod(F.xxhash64(F.lit("train"), "i"), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("b") - WINDOW + 1, F.lit(1))
    place = lambda j: F.pmod(F.xxhash64(F.lit(f"place {j}"), "i"), room).cast("int")
    parts = F.array_distinct(F.array(*[place(j) for j in range(WINDOWS_PER_DOCUMENT)]))
    chosen = usable.filter(draw < share[F.col("y")]).select("i", "y", F.explode(F.transform(parts, lambda p: F.struct(p.alias("p"), F.substring(F.col("b"), p + 1, F.lit(WINDOW)).alias("w")))).alias("x"))
    limit = 2 * per_label * len(labels)
    rows = chosen.select("y", "i", "x.p", "x.w").orderBy(F.xxhash64("i", "p"), "i", "p", "y").limit(limit).collect()
    data = np.zeros((len(rows), WINDOW), np.uint8)
    for k, r in enumerate(rows):
        data[k, : len(r["w"])] = np.frombuffer(bytes(r["w"]), np.uint8)
    return data, np.array([labels.index(r["y"]) for r in rows], np.int64), labels


#: In a worker: the tables that its tasks predict with, built once and not for each task.
_built: dict[str, Predictor] = {}


def predict(text: Column, model: Model, spark: SparkSession) -> Column:
    """struct lang_pred, score. ``und`` with score 0 if the text is null or has no letter, or if nothing was learned."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built.clear()
            _built[name] = Predictor(shared.value)
        predictor = _built[name]
        for texts in batches:
            p = predictor.texts([t or b"" for t in texts])
            best = p.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [predictor.model.languages[b] for b in best], "score": np.clip(np.round(p[np.arange(len(p)), best], 6), 0, 1)})

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return none
    lettered = text.cast("string").rlike(r"\p{L}")
    return F.when(F.coalesce(lettered, F.lit(False)), of(utf8(text))).otherwise(none)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    windows, labels, names = training_windows(df, id_col, text_col, label_col)
    return train(windows, labels, names) if len(labels) else Model([], *[np.zeros(0)] * 5)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))


def identify(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", out: str = "_lang") -> DataFrame:
    """df with one more column: struct lang_pred, score. Learns from ``labelled`` only, and there from text and label.

    Null texts and texts without a letter are ``und``; equal texts are equal; repeated rows stay; other columns pass
    through whatever their names, but a column named like ``out`` is replaced.
    """
    bound_batches(df.sparkSession)
    found = predict(F.col(text_col), fit(labelled, id_col, text_col, label_col), df.sparkSession)
    return df.select(*quoted([c for c in df.columns if c != out]), found.alias(out))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; texts that are null or have no letter are ``und``, null ids held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    found = identify(docs.select("doc_id", "text", "held_out"), docs.filter(~F.col("held_out")))
    return found.select("doc_id", "held_out", "_lang.lang_pred", "_lang.score")
