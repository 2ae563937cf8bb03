"""Benchmark decontamination with an FM-index per shard of the corpus.

Test phrases are the windows of `window` consecutive words of every benchmark item (a shorter item is
one phrase). Each task gathers its documents into shards of bounded size, indexes a shard's words,
finds all phrases by backward search, locates them, and merges what they cover into removal spans.

Words that no phrase of the block holds become breaks, and a run of words shorter than the shortest
phrase is left out of the index: neither can lie in an occurrence, so results are whole.

Scale: the corpus is read once and never shuffled; a task holds one shard. The benchmark is a stated
query set: its size is summed first, and it is sent to the tasks in blocks of about `block_bytes` / 2; with more than
one block each pass adds its findings to those of the passes before. A block's phrases are sorted rows of numbers, made
once and sent as arrays; measured, a block of 4 MB takes a task 90 MB. An item longer than half a block is cut into
pieces that overlap by a phrase less a word, so no phrase is lost.

Defined cases: a null text has no words; a document or item without words has no hits; an item with a
null id is named "null"; repeated items count once, repeated documents each; very long texts are shards of their own and
searched whole; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces
from .fm_index import FMIndex

#: Words of lower-cased UTF-8: anything but ASCII that is no digit or small letter.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20

ADDED = ("n_words", "spans", "items")
SPANS = "array<struct<start:long,end:long>>"
SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return TOKEN.findall(text.lower()) if text else []


class Phrases:
    """The windows of a block of items. `vocabulary`: word -> number from 1; `by_length`: length -> (sorted phrases, one a row;
    where each one's items begin; the items, as places in `names`)."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                own = number.setdefault(name, len(number))
                found.setdefault(min(window, len(ids)), []).append((ids, own))
        self.names = list(number)
        self.by_length = {n: self._sorted(n, found[n]) for n in sorted(found)}
        self.shortest = min(self.by_length, default=0)

    @staticmethod
    def _sorted(length: int, texts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(ids) - length + 1 for ids, _ in texts]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, length) for ids, _ in texts])
        item = np.repeat(np.array([own for _, own in texts], np.int32), sizes)
        order = np.lexsort((item, *rows.T[::-1]))
        rows, item = rows[order], item[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        once = new | np.append(True, item[1:] != item[:-1])
        begins = np.append(np.cumsum(once)[new] - 1, once.sum())
        return rows[new], begins, item[once]

    def items_of(self, length: int, phrase: int) -> list[str]:
        _, begins, item = self.by_length[length]
        return [self.names[k] for k in item[begins[phrase] : begins[phrase + 1]].tolist()]


def occurrences(ids: np.ndarray, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each phrase length: the length, the start of every occurrence in ids, and which phrase it is."""
    edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= phrases.shortest
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts) or not phrases.by_length:
        return
    # the runs one after another, a break (0) after each
    total = int((sizes + 1).sum())
    firsts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    place = np.repeat(starts - firsts, sizes + 1) + np.arange(total)
    seq = np.append(ids, 0)[place]
    index = FMIndex(seq, len(phrases.vocabulary) + 1)
    for length, (rows, _, _) in phrases.by_length.items():
        lo, hi = index.search(rows)
        count = hi - lo
        which = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        yield length, place[index.locate(at)], which


def search_shard(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, merged spans of word positions that phrases cover, and the items."""
    get = phrases.vocabulary.get
    ids, sizes = [], []
    for text in texts:
        own = [get(w, 0) for w in words_of(text)]
        sizes.append(len(own))
        own.append(0)
        ids.append(np.array(own, np.int64))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    first = np.cumsum([0, *(len(x) for x in ids)])
    edges = np.zeros(len(flat) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for length, starts, which in occurrences(flat, phrases):
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
        doc = np.searchsorted(first, starts, side="right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            items.setdefault(d, set()).update(phrases.items_of(length, w))
    covered = np.diff(np.r_[0, (np.cumsum(edges)[:-1] > 0).astype(np.int8), 0])
    begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    spans: dict[int, list[tuple[int, int]]] = {}
    for b, e, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(first, begin, side="right") - 1).tolist(), strict=True):
        spans.setdefault(d, []).append((b - int(first[d]), e - int(first[d])))
    return [(n, spans.get(d, []), sorted(items.get(d, ()))) for d, n in enumerate(sizes)]


def merge_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """item, piece, text: the items, those of more than `most` bytes in pieces of about as many, which overlap by window - 1
    words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            names, numbers, texts = [], [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = [text]
                ws = words_of(text) if text is not None and len(text) > most else []
                if len(ws) >= window:
                    bounds = np.unique(np.cumsum([len(w) + 1 for w in ws]) // most, return_index=True)[1].tolist()
                    own = [b" ".join(ws[a : b + window - 1]) for a, b in zip(bounds, [*bounds[1:], len(ws)], strict=True)]
                    own = [x for x in own if len(words_of(x)) >= window]
                names += [name] * len(own)
                numbers += range(len(own))
                texts += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], ["item", "piece", "text"])

    items = pick(benchmark, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")
    )
    return items.mapInArrow(run, "item string, piece long, text binary")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """docs (text and any others) with n_words, spans (merged, of word positions, end exclusive) and items (ids as
    strings, sorted) added; columns of these names are replaced. With cut the spans are cut out of the texts too."""
    spark = docs.sparkSession
    most = max(1, block_bytes // 2)
    items = item_pieces(benchmark, window, most)
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = int(1 + total // most)
    others = [c for c in docs.columns if c not in ADDED]
    out = docs.select(
        *[F.col(f"`{c}`") for c in others],
        F.lit(0).cast("long").alias("n_words"),
        F.expr(f"cast(array() as {SPANS})").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = out.schema
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        phrases = Phrases(((r["item"], r["text"] and bytes(r["text"])) for r in block.toLocalIterator()), window)
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches, sent=sent, last=k == n_blocks - 1):
            phrases = sent.value
            for batch in pieces(batches, "text", SHARD_BYTES):
                texts = batch.column("text").to_pylist()
                found = search_shard([t.encode() if t else None for t in texts], phrases)
                spans, names = [f[1] for f in found], [f[2] for f in found]
                if n_blocks > 1:
                    old = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
                    spans = [merge_spans(a, b) for a, b in zip(old, spans, strict=True)]
                    names = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), names, strict=True)]
                columns = {c: batch.column(c) for c in others}
                if cut and last:
                    columns["text"] = pa.array([cut_spans(t, x) if x else t for t, x in zip(texts, spans, strict=True)], pa.string())
                columns["n_words"] = pa.array([f[0] for f in found], pa.int64())
                columns["spans"] = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], SPANS_TYPE)
                columns["items"] = pa.array(names, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        out = out.mapInArrow(run, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find(pick(docs, "doc_id", "text"), benchmark, window, block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between the words of one span."""
    raw = text.encode()
    places = [m.span() for m in TOKEN.finditer(raw.lower())]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the removal spans cut out of their texts; rows without spans stay as they are."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = find(docs.select("text", F.struct(*rest).alias("rest")), benchmark, window, block_bytes, cut=True)
    return found.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), i as (
  select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), p as (
  select distinct item, array_to_string(list_slice(ws, k, k + 9), ' ') as w, least(10, len(ws)) as n
  from (select item, ws, unnest(range(1, greatest(2, len(ws) - 8))) as k from i where len(ws) > 0)
), l as (
  select distinct n from p
), f as (
  select rid, k, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') as w
  from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, l where len(ws) >= n)
), o as (
  select f.rid, f.k, f.n, p.item from f join p on f.w = p.w and f.n = p.n
), h as (
  select rid, count(distinct x) as n_hit
  from (select rid, unnest(range(k, k + n)) as x from (select distinct rid, k, n from o)) group by rid
), t as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct rid, item from o) group by rid
)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""
