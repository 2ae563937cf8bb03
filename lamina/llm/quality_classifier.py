"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors: one for each of its words, for each pair of words that follow each
other, for each pair of the first one, two and three characters of such words, and for the character n-grams inside each
word and its edges, all hashed into a fixed number of buckets. A softmax over that average gives the score. Vectors and softmax are trained together by
stochastic gradient descent in numpy.

Scale: training takes a bounded sample of the labelled rows (`max_rows`, `max_chars`), picked by the
hash of doc_id from the narrow labels table. Scoring is one narrow pass over whole texts: as the
softmax is linear in the average, each bucket's vector shrinks to one number first, so a text costs a
few gathers and sums. The model sent to the tasks has a fixed size (4 bytes a bucket).

Defined cases: a null or empty text has no features and gets the score of the bias alone; labels that
are null, or name no document, are left out; without labelled rows every score is 0.5; repeated rows
get equal scores; very long texts are scored whole, CHUNK characters or one text at a time; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4)
STARTS = (1, 2, 3)
EPOCHS = 6
RATE = 4.0
LEAST_DOCS = 5
MAX_ROWS = 4000
MAX_CHARS = 50_000
FOLDS = 5
THRESHOLD = 0.3
CHUNK = 1 << 18

_BASE = np.uint64(0x100000001B3)
_BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)

def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The start of each text in their concatenation (each with a space before and after), and pairs
    (place, bucket) of the features, one pair of arrays for each kind, in order of place."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    raw = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    x = np.where(space, np.uint32(32), raw).astype(np.uint64)
    n = len(x)
    out = []
    for size in GRAMS:
        m = n - size + 1
        if m <= 0:
            continue
        h = np.full(m, size, np.uint64)
        bad = space[:m] & space[1 : m + 1]
        for k in range(size):
            h = h * _BASE + x[k : k + m]
            if 0 < k < size - 1:
                bad = bad | space[k : k + m]
        at = np.flatnonzero(~bad)
        out.append((at, _bucket(h[at])))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begin):
        power = np.cumprod(np.full(n, _BASE, np.uint64))
        inverse = np.cumprod(np.full(n, _BASE_INVERSE, np.uint64))
        total = np.r_[np.uint64(0), np.cumsum((x + np.uint64(1)) * power)]
        word = (total[end] - total[begin]) * inverse[begin]
        out.append((begin, _bucket(word)))
        text_of = np.searchsorted(starts, begin, side="right")
        follows = np.flatnonzero(text_of[1:] == text_of[:-1])
        out.append((begin[follows], _bucket(word[follows] * _BASE + word[follows + 1] * _PAIR)))
        for size in STARTS:
            # the first characters of a word, those after its end as spaces
            front = np.zeros(len(begin), np.uint64)
            for k in range(size):
                at = begin + k
                front = front * _BASE + np.where(at < end, x[np.minimum(at, n - 1)], np.uint64(32)) + np.uint64(1)
            out.append((begin[follows], _bucket((front[follows] * _BASE + front[follows + 1]) * _PAIR + np.uint64(size))))
    return starts, out


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the share of its features that fall in each."""
    found = np.concatenate([b for _, b in features([text])[1]] or [np.zeros(0, np.int64)])
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, (counts / max(1, len(found))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """bucket_score: what a feature of each bucket adds to the logit of label 1; bias: the logit without any."""

    bucket_score: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each text."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            starts, kinds = features(texts[at:end])
            total, count = np.zeros(end - at), np.zeros(end - at)
            for place, bucket in kinds:
                text_of = np.searchsorted(place, starts)
                sums = np.r_[0.0, np.cumsum(self.bucket_score[bucket], dtype=np.float64)]
                bounds = np.r_[text_of, len(place)]
                total += sums[bounds[1:]] - sums[bounds[:-1]]
                count += np.diff(bounds)
            logit = self.bias + total / np.maximum(count, 1)
            out[at:end] = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            at = end
        return out


def train(examples: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7, least_docs: int = LEAST_DOCS) -> Model:
    """Vectors and softmax learned from (text, label 0 or 1) by stochastic gradient descent."""
    if not examples:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    docs = [(*document_features(t), y) for t, y in examples]
    # a bucket of few documents would only learn those by heart: it stays 0, and texts of such features are left to the bias
    seen = np.bincount(np.concatenate([b for b, _, _ in docs]), minlength=BUCKETS) >= least_docs
    vectors[~seen] = 0
    docs = [(b[seen[b]], share[seen[b]], y) for b, share, y in docs]
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            buckets, share, y = docs[k]
            eta = np.float32(rate * (1 - step / steps))
            step += 1
            mean = share @ vectors[buckets]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient of the loss by the logits
            back = out @ p
            out -= eta * 0.1 * np.outer(mean, p)
            bias -= eta * 0.01 * p
            # the share of a bucket makes its step; by the largest one, frequent and rare buckets both learn
            vectors[buckets] -= eta * np.outer(share / share.max() if len(share) else share, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is never learned from: crc32 of doc_id as text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Train on at most max_rows labelled documents of at most max_chars characters, none held out."""
    known = (
        pick(labels, "doc_id", "quality")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(max_rows)
    )
    sample = (
        pick(docs, "doc_id", "text")
        .join(F.broadcast(known), "doc_id")  # at most max_rows rows of two numbers
        .filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
        .limit(max_rows)
    )
    return train([(r["text"], int(r["quality"])) for r in sample.toLocalIterator()])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the model's score of each whole text added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = sent.value.scores([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], [*kept, into])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).cast("double").alias(into)).schema
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(pick(docs, "doc_id", "text"), fit(docs, labels, max_rows, max_chars))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
