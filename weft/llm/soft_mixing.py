"""Mixing to target weights by soft membership.

A classifier learned from a labelled table gives each document a probability for each domain. Documents then get
nonnegative rates r, how often to read them, such that the expected tokens of domain k, sum of r * tokens * p_k over all
documents, come to a target. The rates are the least-squares solution reached from rates of 1 by projected gradient
steps: S_k being the totals at the present rates and M_k those at rates of 1, a step is

    r <- max(0, r - sum_k p_k * (S_k - T_k) / M_k)

the gradient of sum_k (S_k - T_k)^2 / (2 M_k) in the metric of the tokens, in which it has the Lipschitz constant 1, so the
step size is 1; Nesterov's momentum is added. It ends when the targets are met, or, if no rates meet them, when the squared
error falls no more: that is the least-squares solution. If neither happens within STEPS, that is an error. A step needs K
totals of all documents and no more, so it is one pass of a small table with one row of sums from each partition. A rate depends on its document's probabilities and the steps so
far alone: it is worked out anew from the steps in each pass, and nothing is kept between passes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpointing import cut
from weft.llm._common import bound_batches, quoted, spare, table, utf8

#: Shares of all tokens wanted for each domain of (quality, toxic); a domain without a target gets none.
TARGETS = {"q1t0": 0.90, "q0t0": 0.08, "q1t1": 0.015, "q0t1": 0.005}
#: Labelled documents that the classifier is fitted on; buckets of hashed words; relative error to stop at.
FITTED, BUCKETS, ENOUGH = 20_000, 1 << 16, 1e-4
#: Steps after which the rates must have settled; steps without a lower squared error that say they have; a fall that counts.
STEPS, STILL, FALL = 400, 12, 1e-3
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
#: ASCII marks other than full stop and comma.
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"])


def style(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Six numbers about how a text is written."""
    n, size = max(1, len(words)), max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return [math.log1p(len(words)), distinct / n, seen[_MARKS].sum() / size, seen[_DIGIT].sum() / size, seen[_UPPER].sum() / size, size / n / 10]


def buckets(words: set[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


@dataclass
class Classifier:
    domains: list[str]
    odds: np.ndarray  # BUCKETS x K: log probability of a word's bucket in a domain against all domains
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (1 + features) x K

    def features(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        known = set(words)
        odds = self.odds[buckets(known)] if known else np.zeros((1, len(self.domains)))
        return np.concatenate([odds.mean(axis=0) * 10, odds.max(axis=0), style(text or b"", words, len(known))])

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = before = np.zeros((a.shape[1], k))
    target = np.eye(k)[y]
    step = 2.0 / max(1e-9, np.linalg.eigvalsh(a.T @ a / len(a))[-1])
    for i in range(steps):
        v = w + i / (i + 3) * (w - before)
        z = a @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        before, w = w, v - step * (a.T @ (p - target) / len(a) + ridge * v)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "domain", bound: int = FITTED) -> Classifier:
    """Word odds from one half of a bounded sample of labelled documents, weights from the other half.

    The sample are the first ``bound`` labels by a hash of the id, broadcast to the documents: a proven bound. An id with
    several labels counts as its largest, an id of several rows once, with its largest text: the sample is no larger than
    the bound. Domains are the labels of the sample. Without labels there is one domain, called "all".
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("string")).alias("y"))
    chosen = known.withColumn("o", F.xxhash64(F.lit("mix"), F.col("i").cast("string"))).orderBy("o", "i").limit(bound)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).filter("text is not null")
    sample = cut(texts.join(F.broadcast(chosen), "i").groupBy("i", "o", "y").agg(F.max("text").alias("text")).select("o", "y", "text"), "mix")
    domains = [r["y"] for r in sample.select("y").distinct().orderBy("y").collect()]
    if not domains:
        return Classifier(["all"], np.zeros((BUCKETS, 1)), np.zeros(8), np.ones(8), np.zeros((9, 1)))

    @F.pandas_udf("array<int>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([np.unique(buckets(set(t.lower().split()))).astype(np.int32) for t in part])

    half = F.pmod(F.xxhash64(F.lit("half"), "o"), F.lit(2))
    counts = sample.filter(half == 0).select("y", F.explode(hashed(utf8(F.col("text")))).alias("b")).groupBy("y", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = np.full((BUCKETS, len(domains)), 0.0)
    for r in counts:
        seen[r["b"], domains.index(r["y"])] = r["n"]
    total = np.maximum(1.0, seen.sum(axis=0))
    everywhere = (seen.sum(axis=1) + 1) / (total.sum() + BUCKETS)
    odds = np.log((seen + 8 * everywhere[:, None] * BUCKETS / 8) / (total + BUCKETS)) - np.log(everywhere)[:, None]
    draft = Classifier(domains, odds, np.zeros(1), np.ones(1), np.zeros((1, 1)))
    shared = docs.sparkSession.sparkContext.broadcast(draft)

    @F.pandas_udf("array<double>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([shared.value.features(t) for t in part])

    rows = sample.filter(half == 1).select("o", "y", F.xxhash64("text").alias("h"), described(utf8(F.col("text"))).alias("x")).toPandas().sort_values(["o", "h", "y"])
    if not len(rows):
        return Classifier(domains, odds, np.zeros(2 * len(domains) + 6), np.ones(2 * len(domains) + 6), np.zeros((2 * len(domains) + 7, len(domains))))
    x, y = np.array(rows["x"].tolist(), float), np.array([domains.index(v) for v in rows["y"]])
    return Classifier(domains, odds, *_softmax_fit(x, y, len(domains)))


def classify(text: Column, model: Classifier, spark: SparkSession) -> Column:
    """struct n (tokens), p0, p1, ... (probabilities in the order of model.domains)."""
    shared = spark.sparkContext.broadcast(model)
    names = [f"p{i}" for i in range(len(model.domains))]

    @F.pandas_udf("n long, " + ", ".join(f"{c} double" for c in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            p = m.posteriors(np.array([m.features(t) for t in texts]).reshape(len(texts), -1))
            yield pd.DataFrame({"n": [len((t or b"").split()) for t in texts], **{c: p[:, i] for i, c in enumerate(names)}})

    return of(utf8(text))


def _momentum(t: int) -> float:
    return t / (t + 3)


def rates_after(p: np.ndarray, steps: list[np.ndarray], ahead: bool = False) -> np.ndarray:
    """Rates after these steps; with ``ahead`` the point where the next gradient is taken."""
    rate = before = np.ones(len(p))
    for t, g in enumerate(steps):
        point = rate + _momentum(t) * (rate - before)
        before, rate = rate, np.maximum(0.0, point - p @ g)
    return rate + _momentum(len(steps)) * (rate - before) if ahead else rate


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, enough: float = ENOUGH) -> tuple[list[np.ndarray], np.ndarray]:
    """members (n, p0, ...) -> the steps, and the totals at the last rates. A domain that no document has gets none."""
    names = [f"p{i}" for i in range(len(domains))]

    def totals(done: list[np.ndarray], ahead: bool) -> np.ndarray:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(len(names))
            for part in batches:
                p = part[names].to_numpy(float)
                out += (part["n"].to_numpy(float) * rates_after(p, done, ahead)) @ p
            yield pd.DataFrame([out], columns=names)

        row = members.select("n", *names).mapInPandas(sums, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
        return np.array([row[c] or 0.0 for c in names])

    base = totals([], False)
    want = np.array([targets.get(d, 0.0) for d in domains])
    want = base.sum() * (want / want.sum() if want.sum() else base / max(1e-300, base.sum()))
    done: list[np.ndarray] = []
    least, since = math.inf, 0
    for _ in range(steps):
        at = totals(done, True) if done else base
        if (np.abs(at - want) <= enough * np.maximum(want, base.sum() * enough)).all():
            break
        error = np.where(base > 0, (at - want) / np.maximum(base, 1e-300), 0.0)
        squared = float(error @ (at - want))
        since = 0 if squared < least * (1 - FALL) else since + 1
        least = min(least, squared)
        if since >= STILL:
            break
        done.append(error)
    else:
        raise RuntimeError(f"the rates didn't settle in {steps} steps: {at.tolist()} instead of {want.tolist()}")
    return done, totals(done, False) if done else base


def mix(df: DataFrame, model: Classifier, targets: dict[str, float], text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """df with one more column ``_mix``: struct tokens, p (probabilities by domain name), rate, copies.

    copies is rate rounded up or down by a hash of id and text, so its expectation over documents is the rate. Null
    and empty texts have no tokens and their rate moves no total. All other columns pass through whatever their names;
    a column ``_mix`` is replaced; rows that repeat get equal values; an empty table gives no rows.
    """
    spark = df.sparkSession
    names = [f"p{i}" for i in range(len(model.domains))]
    (made,) = spare(df, "weft_rate")
    # columns that pass are written too: the classifier runs once, and rates are read from the same numbers
    kept = [c for c in df.columns if c != "_mix"]
    scored = cut(df.select(*quoted(kept), classify(F.col(text_col), model, spark).alias("_mix")), "mixed")
    steps, _ = solve(scored.select("_mix.*"), model.domains, targets)

    @F.pandas_udf("double")
    def rate(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.round(rates_after(np.column_stack([c.to_numpy(float) for c in columns]), steps), 6))

    u = (F.shiftrightunsigned(F.xxhash64(F.lit("copies"), F.col(key_col).cast("string"), F.col(text_col)), 11).cast("double") + 0.5) * 2.0**-53
    rated = scored.withColumn(made, rate(*[F.col(f"_mix.{c}") for c in names]))
    p = F.struct(*[F.round(F.col(f"_mix.{c}"), 6).alias(d) for c, d in zip(names, model.domains, strict=True)])
    return rated.select(*quoted(kept), F.struct(F.col("_mix.n").alias("tokens"), p.alias("p"), F.col(made).alias("rate"), F.floor(F.col(made) + u).cast("int").alias("copies")).alias("_mix"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> (doc_id, domain): four domains such as q1t0."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null and empty texts have no tokens, equal rows equal rates."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, quality_domains(table(spark, sf_dir, "labels")))
    k1 = F.xxhash64("text")
    slim = docs.select("doc_id", k1.alias("k"), "text")
    out = mix(slim, model, TARGETS)
    return out.select("doc_id", F.col("_mix.tokens").alias("n_tokens"), *[F.col(f"_mix.p.{d}").alias(f"p_{d}") for d in model.domains], F.col("_mix.rate").alias("rate"), F.col("_mix.copies").alias("copies"))
