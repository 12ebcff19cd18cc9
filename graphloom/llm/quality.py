"""Quality classification by positive-unlabelled learning.

Trusted positives are texts labelled 1; all web text that may be learnt from is unlabelled.  A small network
minimises the non-negative unbiased risk: the unlabelled risk less the positives' share of it (class prior
times the positives' risk as negatives) stands for the negatives' risk, and where a batch drives it below
zero, the step goes the other way.  The class prior is estimated from positives and unlabelled texts alone: a linear
score is fitted on one half of either sample; on the other half the share of unlabelled texts above a threshold, divided
by the positives' share there, bounds the prior from above, and the threshold with the least confidence bound is taken.
Rows labelled 0 are never used.

The network is fitted on the driver on a bounded sample (``positives`` and ``unlabelled`` rows, chosen by a
hash of doc_id); scoring reads every whole text on the executors.

Defined cases: null and empty texts get the score of a text without characters; a document with several
labels counts as 1 only if all are 1; null labels are none; without positives all scores are 0.5; lengths enter as
logarithms and features are scaled by their middle nine tenths, so a few extreme texts change no other text's score;
rows are scored one by one, whatever repeats; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, table

FOLDS, THRESHOLD, POSITIVES, UNLABELLED = 5, 0.3, 3000, 6000
BIGRAMS, CUT = 256, 3

#: Classes of ASCII bytes: 0 blank, 1 lower, 2 upper, 3 digit, 4 sentence signs, 5 other signs, 6 beyond ASCII, 7 control.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = [0 if c in b" \t\n\r\x0b\x0c" else 1 if chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 4 if chr(c) in ".,;:'\"-?()" else 7 if c < 32 or c == 127 else 5 for c in range(128)]
DENSE = 26


def features(text: str | None) -> np.ndarray:
    """Shape of the whole text, and its hashed pairs of bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DENSE + BIGRAMS, np.float32)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    kinds = _CLASS[b]
    share = np.bincount(kinds, minlength=8) / len(b)
    words = raw.split()
    n = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    heads = sum(w[:1].isupper() for w in words)
    tails = np.fromiter((w[-1] for w in words), np.uint8, len(words)) if words else np.zeros(1, np.uint8)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words))
    out[:DENSE] = (
        *share, np.log1p(len(b)) / 10, np.log1p(n) / 8, distinct / n, np.log(distinct + 1) / np.log(n + 1), again / n, heads / n,
        np.log1p(lengths.mean()) / 2, np.log1p(lengths.std()) / 2, np.log1p(lengths.max()) / 4, (_CLASS[tails] == 5).mean(), (_CLASS[tails] == 4).mean(),
        words.count(b"|") / n, (lengths == 1).mean(), len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 5, sum(x[-1:] in b".!?" for x in lines) / max(len(lines), 1),
        np.log1p(share[2] / (share[1] + 1e-3)), 1,
    )
    pairs = (_CLASS[b[:-1]].astype(np.uint32) * 8 + kinds[1:]) if len(b) > 1 else np.zeros(0, np.uint32)
    out[DENSE : DENSE + 64] = np.sqrt(np.bincount(pairs, minlength=64) / max(len(pairs), 1))
    if len(b) > 1:
        h = ((b[:-1].astype(np.uint32) * 257 + b[1:]) * np.uint32(2654435761) >> 16) % (BIGRAMS - 64)
        out[DENSE + 64 :] = np.sqrt(np.bincount(h, minlength=BIGRAMS - 64) / len(h))
    return out


@dataclass
class Model:
    """Scaled features, one hidden layer."""

    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.w2):
            return np.full(len(x), self.prior)
        z = np.tanh(scaled(x, self.middle, self.scale) @ self.w1)
        return 1 / (1 + np.exp(-np.clip(np.c_[z, np.ones(len(x))] @ self.w2, -30, 30)))


def scaled(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in units of their spread, cut at CUT, and a constant."""
    return np.c_[np.clip((x - middle) / scale, -CUT, CUT), np.ones(len(x))]


def class_prior(p: np.ndarray, u: np.ndarray, rng: np.random.Generator, splits: int = 16, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, less one standard error; both as scaled features."""
    found = []
    for _ in range(splits):
        (p1, p2), (u1, u2) = (np.array_split(x[rng.permutation(len(x))], 2) for x in (p, u))
        if not len(p2) or not len(u2):
            return 0.5
        a, y = np.r_[p1, u1], np.r_[np.ones(len(p1)), -np.ones(len(u1))]
        weight = np.r_[np.full(len(p1), 1 / len(p1)), np.full(len(u1), 1 / len(u1))][:, None]
        w = np.linalg.solve(a.T @ (a * weight) + 0.1 * np.eye(a.shape[1]), a.T @ (y[:, None] * weight))[:, 0]
        sp, su = np.sort(p2 @ w), np.sort(u2 @ w)
        at = np.r_[sp, su]
        above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
        at = above_p > 0
        slack = np.sqrt(np.log(4 / doubt) / (2 * len(su))) + np.sqrt(np.log(4 / doubt) / (2 * len(sp)))
        best = np.argmin((above_u[at] + slack) / above_p[at])
        found.append((above_u[at] / above_p[at])[best])
    share = np.clip(np.mean(found), 0.02, 0.98)
    return float(max(share - np.sqrt(share * (1 - share) / len(u)), 0.02))  # too high a prior would hide negatives


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 24, steps: int = 1500, seed: int = 7) -> Model:
    """Minimises the non-negative unbiased risk with the sigmoid loss, by Adam."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(1), np.ones(1), np.zeros(1), np.zeros(0), 0.5)
    rng = np.random.default_rng(seed)
    low, middle, high = np.quantile(unlabelled, [0.05, 0.5, 0.95], axis=0)
    scale = (high - low) / 3.3 + 0.1
    p, u = scaled(positive, middle, scale), scaled(unlabelled, middle, scale)
    prior = class_prior(p, u, rng)
    w = [rng.normal(0, 0.3 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), rng.normal(0, 0.1, hidden + 1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def grads(x: np.ndarray, d_out) -> tuple[float, list[np.ndarray]]:
        """d_out: from the network's outputs to the loss and its derivative."""
        z = np.tanh(x @ w[0])
        z1 = np.c_[z, np.ones(len(x))]
        loss, d = d_out(z1 @ w[1])
        return loss, [x.T @ (np.outer(d, w[1][:-1]) * (1 - z * z)), z1.T @ d]

    def as_class(f: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """The sigmoid loss, which is bounded: a class prior that is a little too high can't outweigh the negatives."""
        wrong = 1 / (1 + np.exp(np.clip(sign * f, -30, 30)))
        return wrong.mean(), -sign * wrong * (1 - wrong) / len(f)

    as_pos, as_neg = (lambda f: as_class(f, 1)), (lambda f: as_class(f, -1))
    for t in range(1, steps + 1):
        bp, bu = p[rng.integers(0, len(p), min(256, len(p)))], u[rng.integers(0, len(u), min(512, len(u)))]
        _, gp = grads(bp, as_pos)
        pn, gpn = grads(bp, as_neg)
        un, gun = grads(bu, as_neg)
        if un - prior * pn >= 0:
            g = [prior * a + c - prior * b for a, b, c in zip(gp, gpn, gun, strict=True)]
        else:
            g = [prior * b - c for b, c in zip(gpn, gun, strict=True)]
        rate = 0.003 * (1 - t / (steps + 1)) + 1e-5
        for i in range(2):
            g[i] = g[i] + 1e-4 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(middle, scale, w[0], w[1], prior)


def _featured(docs: DataFrame) -> np.ndarray:
    """Features of a bounded number of texts, ordered by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"])))
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), DENSE + BIGRAMS).astype(np.float64)


def share_below(key: Column, wanted: int, there: int) -> Column:
    """Whether a row is in a sample of about the wanted size, by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, wanted / max(there, 1)) * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """learn: condition on docs; labels: doc_id, quality.  At most about so many rows of either kind are fitted."""
    known = labels.where("quality is not null").groupBy(F.col("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")).where(learn & F.expr("quality = 1"))
    good = known.count()
    candidates = docs.where(learn)
    some = candidates.where(share_below(F.col("doc_id"), unlabelled, candidates.select("doc_id").count()))
    trusted = candidates.join(F.broadcast(known.where(share_below(F.col("doc_id"), positives, good)).select("doc_id")), "doc_id", "left_semi")
    return fit(_featured(trusted), _featured(some))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the score of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), DENSE + BIGRAMS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(np.clip(x, -1e6, 1e6)), pa.float64())], [*b.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), FOLDS) != 0)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with their columns."""
    return score(docs, learned(docs, labels), "__quality").where(F.col("__quality") >= threshold).drop("__quality")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), learned(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
