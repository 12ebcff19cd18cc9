"""Language identification by error-correcting output codes.

Every language gets a code word; for each of its bits a binary classifier over hashed byte n-grams predicts
the bit.  Loss-weighted decoding compares the predictions with every code word, weighing each bit by how
well its classifier does on that language, and chooses the nearest; a text whose two nearest code words
are about as near is flagged as ambiguous.

The classifiers are ridge regressions, fitted on the driver on a bounded sample (``sample`` rows, shared
evenly by the languages, chosen by a hash of doc_id); prediction reads every whole text on the executors.

Defined cases: null texts and texts without a letter are "und" with score 0; null langs are not learnt;
without rows to learn from all is "und"; with one language all texts with a letter get it; rows are
predicted one by one, whatever repeats; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, table

FOLDS, LEARN_NOT, SAMPLE, BUCKETS = 4, 2, 2400, 2048
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BYTES = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
RESULT = "doc_id long, lang_pred string, score double, ambiguous boolean"


def features(text: str) -> np.ndarray:
    """Shares of the hashed byte n-grams of one to three letters, as unit vector of their square roots."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BYTES) + b" ", np.uint8).astype(np.uint32)
    b = b[np.r_[True, (b[1:] != 0x20) | (b[:-1] != 0x20)]]
    two = b[:-1] << 8 | b[1:]
    three = (two[:-1] << 8 | b[2:]) if len(two) > 1 else two[:0]
    grams = np.concatenate([b, two + np.uint32(1 << 9), three + np.uint32(1 << 25)])
    x = np.sqrt(np.bincount(grams * np.uint32(2654435761) >> 21, minlength=BUCKETS)).astype(np.float32)
    return x / (np.linalg.norm(x) or 1)


def code_words(n: int, seed: int = 11) -> np.ndarray:
    """n code words of +1 and -1: all splits for up to seven languages, else random distinct balanced columns."""
    if n <= 7:  # of eight there are 35 balanced splits and 30 are wanted
        columns = [[1 if i == 0 else 1 - 2 * (k >> (i - 1) & 1) for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(columns or [[1] * n]).T
    rng, columns = np.random.default_rng(seed), {}
    while len(columns) < max(15, int(10 * np.log2(n))):
        c = rng.permutation(np.r_[np.ones(n // 2), -np.ones(n - n // 2)]).astype(int)
        columns.setdefault(tuple(c * c[0]), c)
    return np.array(list(columns.values())).T


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, share of the score, and whether the choice is ambiguous."""
        bits = np.c_[x, np.ones(len(x))] @ self.weights
        loss = np.stack([(np.exp(-np.clip(c * bits, -4, 4)) * t).sum(1) for c, t in zip(self.codes, self.trust, strict=True)], 1)
        like = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        like /= like.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(like, 1)
        margin = top[:, -1] - (top[:, -2] if loss.shape[1] > 1 else 0)
        return best, like[np.arange(len(x)), best], margin < 0.2


def fit(x: np.ndarray, lang: list[str], ridge: float = 0.3) -> Model | None:
    langs = sorted(set(lang))
    if not langs:
        return None
    codes = code_words(len(langs))
    at = np.array([langs.index(v) for v in lang])
    y = codes[at].astype(np.float64)
    size = np.bincount(at)
    w = (len(at) / len(langs) / size[at]) ** 0.5  # each language counts alike
    a = np.c_[x, np.ones(len(x))].astype(np.float64) * w[:, None]
    dual = a @ a.T
    dual[np.diag_indices_from(dual)] += ridge
    weights = a.T @ np.linalg.solve(dual, y * w[:, None])
    # How often each bit is right for each language, as weight of its loss; rows of one language sum to 1.
    right = np.sign(np.c_[x, np.ones(len(x))] @ weights) == y
    trust = np.stack([right[at == i].mean(0) + 1e-6 for i in range(len(langs))])
    return Model(langs, codes, weights.astype(np.float32), trust / trust.sum(1, keepdims=True))


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model | None:
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang").where(F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = max(1, sample // max(len(counts), 1))
    share = F.create_map(*(v for k, n in sorted(counts.items()) for v in (F.lit(k), F.lit(int(min(1.0, each / n) * (1 << 30)))))) if counts else F.lit(None)
    if not counts:
        return None
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

    found = sorted((r["lang"], bytes(r["x"])) for r in some.select("lang", "text").mapInArrow(run, "lang string, x binary").collect())
    return fit(np.array([np.frombuffer(x, np.float32) for _, x in found]).reshape(len(found), BUCKETS), [v for v, _ in found])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
            lang, score, odd = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known:
                best, share, unsure = model.predict(np.array([features(texts[i]) for i in known]))
                score[known], odd[known] = share, unsure
                for i, k in zip(known, best, strict=True):
                    lang[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and ambiguous) of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == LEARN_NOT
    model = train(docs, ~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
