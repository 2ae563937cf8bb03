"""Personal data: exact patterns, made consistent over each document by a skip-chain conditional random field.

The nodes of a document's field are its mentions (stretches of digits with separators, and words with
an @). A node's own potential comes from features of its shape. Mentions that follow each other share a
chain potential; distant mentions that say the same (equal digits, equal words around the @, equal four
parts of an address) share one skip potential, and those that say something similar (equal last seven
digits, equal name before the @) another. Mentions that a pattern matches are clamped to its label. Loopy
belief propagation gives every other mention its label, and what is no "none" with enough belief is an added span.

All weights are learned together in numpy by the field's pseudo-likelihood: the probability of each mention's label
given its shape and its neighbours' labels. The examples are a bounded sample of documents (`max_rows` of them that
hold what may be personal data, a quarter as many of any kind, `max_chars` characters each at most), with the patterns'
matches as labels. As the patterns' matches tell little of other forms, each example gets later mentions of its own in
other forms (`other_forms`), of what matches with that label and of some of the rest with none.

Scale: one narrow pass over the texts. The fields of all documents of a piece (a few megabytes) are one sparse graph
without edges between documents, and messages pass in all of them at once; a graph has about as many edges as
mentions, as each is tied to the one before it and to the first and the last that is alike. The model is a few hundred
numbers.

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned each by itself;
very long texts are scanned whole, in time linear in their length; without a sample only the patterns find spans; an
empty table gives no rows; spans are in code points, end exclusive, and an added one overlaps no matched one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MAX_ROWS = 2000
MAX_CHARS = 50_000
ROUNDS = 12
CONFIDENCE = 0.9
CHAIN_CHARS = 80
#: Kinds of edges.
CHAIN, SAME, SIMILAR = range(3)
#: What a document must hold to be one of the sample's first rows.
CANDIDATE = r"@|[0-9][0-9 ().-]{5,}[0-9]"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9])*")
PART = re.compile(r"[0-9]+")
NOT_DIGIT = re.compile(r"[^0-9]")
TRIM = ".,;:!?\"'()[]<>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of every pattern match, sorted."""
    out = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def mentions(text: str) -> list[tuple[int, int]]:
    """The nodes: words with one @, and in what they leave trimmed stretches of digits with separators; in order."""
    out: list[tuple[int, int]] = []

    def trimmed(start: int, end: int) -> None:
        while start < end and text[start] in TRIM and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in TRIM:
            end -= 1
        if end > start:
            out.append((start, end))

    def numbers(start: int, end: int) -> None:
        for m in NUMBER.finditer(text, start, end):
            trimmed(*m.span())

    free, at = 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > free and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end] != "@" and not text[end].isspace():
            end += 1
        numbers(free, start)
        trimmed(start, end)
        free, at = end, text.find("@", end)
    numbers(free, len(text))
    return out


def labelled(nodes: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each node: of the span that overlaps it most, or 0."""
    out, k = [], 0
    longest = max((e - s for s, _, e in spans), default=0)
    for start, end in nodes:
        while k < len(spans) and spans[k][0] + longest <= start:
            k += 1
        best = (0, 0)
        for i in range(k, len(spans)):
            s, kind, e = spans[i]
            if s >= end:
                break
            best = max(best, (min(e, end) - max(s, start), kind + 1))
        out.append(best[1] if best[0] > 0 else 0)
    return out


def likeness(mention: str) -> tuple[str | None, str | None]:
    """What mentions that say the same have in common, and what similar ones have."""
    if "@" in mention:
        word = mention.lower()
        name = word.split("@")[0]
        return word, f"{name}@" if len(name) >= 3 else None
    digits = NOT_DIGIT.sub("", mention)
    if len(digits) <= 12:
        parts = PART.findall(mention)
        if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts):
            return ".".join(str(int(p)) for p in parts), None
    return (digits, digits[-7:]) if len(digits) >= 7 else (None, None)


def shape(mention: str) -> list[float]:
    """Features of one mention's form."""
    parts = PART.findall(mention)
    digits = sum(map(len, parts))
    dots = mention.count(".")
    size = [float(lo <= digits < hi) for lo, hi in ((0, 1), (1, 4), (4, 7), (7, 10), (10, 14), (14, 20), (20, 1 << 30))]
    marks = [float(c in mention) for c in "@+- ()/"]
    quad = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    luhn = 14 <= digits <= 19 and _luhn("".join(parts))
    named = "@" in mention and "." in mention.split("@")[1]
    return [1.0, *size, *marks, float(dots == 1), float(dots == 2), float(dots == 3), float(dots > 3), float(quad), float(luhn), float(named), float(len(parts) == 1)]


N_FEATURES = len(shape("0"))


def edges(texts: list[str], places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """First node, second node and kind of each edge of a document's field."""
    out = []
    seen: tuple[dict[str, tuple[int, int]], ...] = ({}, {})
    keys = [likeness(t) for t in texts]
    for k in range(len(texts)):
        if k and places[k][0] - places[k - 1][1] <= CHAIN_CHARS:
            out.append((k - 1, k, CHAIN))
        for kind, held, key in ((SAME, seen[0], keys[k][0]), (SIMILAR, seen[1], keys[k][1])):
            if key is None:
                continue
            first, last = held.get(key, (k, k))
            for other in {first, last} - {k}:
                if kind == SAME or keys[other][0] != keys[k][0]:
                    out.append((other, k, kind))
            held[key] = first, k
    return out


@dataclass(frozen=True)
class Graph:
    """The fields of some documents: features of all mentions, edges between them (places in the features, kinds), and the
    label of each mention that a pattern matches, or 0."""

    features: np.ndarray
    source: np.ndarray
    target: np.ndarray
    kind: np.ndarray
    known: np.ndarray


def graph(documents: list[tuple[list[str], list[tuple[int, int]], list[int]]]) -> Graph:
    """Of each document's mentions: their texts, places and known labels."""
    rows, ties, known = [], [], []
    for texts, places, labels in documents:
        first = len(rows)
        rows += [shape(t) for t in texts]
        ties += [(a + first, b + first, kind) for a, b, kind in edges(texts, places)]
        known += labels
    e = np.array(ties, np.int64).reshape(-1, 3)
    return Graph(np.array(rows, float).reshape(-1, N_FEATURES), e[:, 0], e[:, 1], e[:, 2], np.array(known, np.int64))


@dataclass(frozen=True)
class Field:
    """weights: features x labels; ties: for each kind of edge label x label log potentials, symmetric."""

    weights: np.ndarray
    ties: np.ndarray

    def beliefs(self, g: Graph) -> np.ndarray:
        """The marginal of each label for each mention, by loopy sum-product; known labels above 0 are clamped."""
        node = g.features @ self.weights
        node -= node.max(axis=1, keepdims=True, initial=-np.inf)
        fixed = np.flatnonzero(g.known)
        node[fixed] = -50.0
        node[fixed, g.known[fixed]] = 0.0
        total = node
        if len(g.source):
            source, target = np.concatenate((g.source, g.target)), np.concatenate((g.target, g.source))
            table = self.ties[np.concatenate((g.kind, g.kind))]
            m = len(g.source)
            back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
            order = np.argsort(target, kind="stable")
            ends = np.flatnonzero(np.diff(target[order], prepend=-1))
            messages = np.zeros((2 * m, len(LABELS)))
            for k in range(ROUNDS + 1):
                total = node.copy()
                total[target[order][ends]] += np.add.reduceat(messages[order], ends)
                if k == ROUNDS:
                    break
                out = total[source] - messages[back]
                joint = out[:, :, None] + table
                top = joint.max(axis=1)
                new = np.log(np.exp(joint - top[:, None, :]).sum(axis=1)) + top
                messages = 0.5 * messages + 0.5 * (new - new.max(axis=1, keepdims=True))
        p = np.exp(total - total.max(axis=1, keepdims=True, initial=-np.inf))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans of mentions that no pattern matches and the field labels with enough belief."""
        places = [mentions(t) for t in texts]
        documents = [([t[a:b] for a, b in own], own, labelled(own, spans)) for t, own, spans in zip(texts, places, base, strict=True)]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not any(places):
            return out
        g = graph(documents)
        p = self.beliefs(g)
        best = p.argmax(axis=1)
        chosen = (g.known == 0) & (best > 0) & (p.max(axis=1) >= CONFIDENCE)
        first = np.cumsum([0, *map(len, places)])
        for k in np.flatnonzero(chosen).tolist():
            d = int(np.searchsorted(first, k, side="right")) - 1
            start, end = places[d][k - int(first[d])]
            out[d].append((start, int(best[k]) - 1, end))
        return out


def other_forms(mention: str, label: int, rng: random.Random) -> str:
    """The mention again, as people write it another time, so that no pattern matches it."""
    parts = PART.findall(mention)
    digits = "".join(parts)
    if LABELS[label] == "email":
        return mention.rsplit(".", 1)[0].split(".")[0] if rng.random() < 0.3 and "@" in mention.split(".")[0] else mention.split("@")[0] + "@" + mention.split("@")[1].split(".")[0]
    if LABELS[label] == "ip":
        return rng.choice("-/ ").join(parts)
    if LABELS[label] == "card":
        return rng.choice("./").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if LABELS[label] == "phone":
        form = rng.randrange(3)
        if form == 0:
            return digits
        if form == 1:
            return "00" + rng.choice(" -/").join((digits[:2], digits[2:5], digits[5:]))
        cut = rng.choice((1, 2, 3))
        return "0" + rng.choice(" -/").join((digits[cut : cut + 3], digits[cut + 3 :]))
    if "@" in mention or not digits:
        return mention.upper()
    return rng.choice("-./ ").join(parts) if len(parts) > 1 else rng.choice(" -").join((digits[:3], digits[3:])) if len(digits) > 3 else digits


def _example(text: str, rng: random.Random) -> tuple[list[str], list[tuple[int, int]], list[int]]:
    """A text's mentions and labels, with later mentions in other forms."""
    places = mentions(text)
    labels = labelled(places, base_spans(text))
    texts = [text[a:b] for a, b in places]
    at = len(text)
    for t, label in zip(list(texts), list(labels), strict=True):
        if label or rng.random() < 0.3:
            again = other_forms(t, label, rng)
            at += rng.choice((5, 5 * CHAIN_CHARS))
            texts.append(again)
            places.append((at, at + len(again)))
            labels.append(label)
            at += len(again)
    return texts, places, labels


def train(texts: list[str], steps: int = 400, rate: float = 0.5, seed: int = 3) -> Field:
    """The field learned from texts, with the patterns' matches as labels."""
    rng = random.Random(seed)
    weights, ties = np.zeros((N_FEATURES, len(LABELS))), np.zeros((3, len(LABELS), len(LABELS)))
    g = graph([_example(t, rng) for t in texts])
    n = len(g.known)
    if not n:
        return Field(weights, ties)
    y = np.eye(len(LABELS))[g.known]
    near = np.zeros((3, n, len(LABELS)))  # per kind of edge: how many neighbours of each label
    np.add.at(near, (g.kind, g.source), y[g.target])
    np.add.at(near, (g.kind, g.target), y[g.source])
    # the rare labels count as much together as the frequent "none"
    each = np.where(g.known > 0, 0.5 / max(1, (g.known > 0).sum()), 0.5 / max(1, (g.known == 0).sum()))[:, None]
    held = [np.zeros_like(weights), np.zeros_like(ties)]
    for _ in range(steps):
        z = g.features @ weights + np.einsum("kna,kab->nb", near, ties)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - y) * each
        by_tie = np.einsum("kna,nb->kab", near, p)
        slopes = [g.features.T @ p + 1e-5 * weights, (by_tie + by_tie.transpose(0, 2, 1)) / 2 + 1e-5 * ties]
        for value, slope, square in zip((weights, ties), slopes, held, strict=True):
            square += slope * slope
            value -= rate * slope / (np.sqrt(square) + 1e-8)
    return Field(weights, ties)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Field:
    """The field learned from a bounded sample of documents, picked by hash."""
    texts = pick(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    first = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = first(texts.filter(F.regexp_like("text", F.lit(CANDIDATE))), max_rows).union(first(texts, max_rows // 4)).distinct()
    most = max_rows + max_rows // 4
    sample = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)  # ids: at most `most` numbers
    return train([r["text"] for r in sample.toLocalIterator()])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


COLUMNS = ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added (spans of the field) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            rows = []
            for base, more in zip(bases, sent.value.added(texts, bases), strict=True):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                own = listed(base)
                rows.append((*counts, hashlib.sha256(own.encode()).hexdigest(), listed([*base, *more]), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], list(COLUMNS)
            )

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def report(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    return scan(docs, fit(docs, max_rows, max_chars))
