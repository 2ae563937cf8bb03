"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are walks: pieces between punctuation, read as words. The nodes of the graph are phrases of three words, its edges
phrases of four, which lead from their first three words to their last three and weigh as often as they occur. Only the longest
phrases are counted. A place where no edge starts, as the piece ends there, is an end of the one to three words that are
left. Then a phrase of three words occurs as often as the edges that leave its node weigh, plus its ends; a phrase of two as the
nodes that begin with it do, plus its ends; and a word likewise.

Paths of nodes with one edge in and one out are compacted: their edges become one row of words and weights.

Only phrases with `least` occurrences or more can be candidates, and so can their parts. Before the graph is made, the hashes of words, of pairs
of such words, of triples of such pairs and of edges of such triples are counted, and a place's longest phrase also ends where it
would occur less often. Each level's hashes are sent as a bitmap of fixed size, so it may let rare ones through, never hold frequent ones
back: the counts of frequent phrases are exact, and words are compared as words, hashes only choose.

Scale: each pass reads the texts where they are, and moves sums per task: of hashes, and in the last of phrases, many in a row. The
bitmaps have 2**BITS bits whatever the data. Sums are partial before each shuffle, so a frequent phrase costs as much as a
rare one. Pointers along paths are doubled, so a path of any length takes few rounds, and a path's row has PART edges at
most. The best `top` of a language are chosen in every task before they meet.

Defined cases: a null text is empty; a null language is `und`; repeated rows count again; texts of any length are read
whole; words of a language without candidates make no rows, nor does an empty table; equal scores are ordered by
occurrences, then by the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, forget, pick, pieces
from .graph import connected
from .shingles import mixed, run_hashes

LEAST = 30
TOP = 2000
KEEP_PERCENT = 80
SCALE = 2_000_000
LONGEST = 4
#: The bitmaps of frequent hashes have 2**BITS bits.
BITS = 26
#: Edges in one row of a path.
PART = 1024
PIECE_BYTES = 1 << 20
#: Phrases that a task sums up before it passes them on.
HELD_PHRASES = 400_000
#: Phrases of one language that travel together, about.
BUCKET_PHRASES = 5_000

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAPS = _ENDS.copy()
_GAPS[[9, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Walk:
    """The words of some texts of one language: hash of each, where its piece ends, and the words with one space after each."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        gap = _GAPS[raw]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.n = len(begin)
        if not self.n:
            return
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        self.words = run_hashes(raw, begin, end) ^ salt
        piece = np.cumsum(_ENDS[raw])[begin]
        self.together = piece[1:] == piece[:-1]
        kept = ~gap
        kept[end] = True
        spaced = raw.copy()
        spaced[end] = 32
        self.data = spaced[kept].tobytes()
        place = np.cumsum(kept) - 1
        self.begin, self.end = place[begin], place[end]

    def hashes(self, k: int) -> np.ndarray:
        """Of the k words from each place, whatever pieces they are in."""
        h = self.words
        for j in range(1, k):
            h = mixed(h[: self.n - j] * _FACTOR + self.words[j:])
        return h

    def candidates(self, k: int, bitmaps: list[np.ndarray]) -> np.ndarray:
        """Where k words start within a piece whose parts of k - 1 words, and theirs, the bitmaps hold."""
        if k == 1:
            return np.ones(self.n, bool)
        if self.n < k:
            return np.zeros(0, bool)
        part = self.candidates(k - 1, bitmaps) & _among(self.hashes(k - 1), bitmaps[k - 2])
        both = part[1:] & part[:-1]
        return both & self.together if k == 2 else both


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - int(len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Walk]]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            walk = Walk(lang, some)
            if walk.n:
                yield lang, walk


def _counter(k: int, bitmaps: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b.value, np.uint8) for b in bitmaps]
        for _, walk in _walks(batches):
            at = walk.candidates(k, held)
            if at.any():
                hashes, n = np.unique(walk.hashes(k)[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return run


def frequent(texts: DataFrame, least: int, bits: int) -> tuple[list, int]:
    """Broadcast bitmaps of the hashes of phrases of one to four words that occur `least` times or more, 2**bits bits each, and how many
    bits are set in them."""
    sc, found, n_set = texts.sparkSession.sparkContext, [], 0
    for k in range(1, LONGEST + 1):
        counts = texts.mapInArrow(_counter(k, found), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        slot = F.shiftrightunsigned("gram", 64 - bits)
        parts = counts.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
        whole = bytearray(1 << (bits - 3))
        for part, held in parts.collect():  # 2**(bits - 15) rows of 4 KB at most
            whole[part * 4096 : part * 4096 + len(held)] = held
        n_set += int(np.bitwise_count(np.frombuffer(whole, np.uint8)).sum(dtype=np.int64))
        found.append(sc.broadcast(bytes(whole)))
    return found, n_set


PACKED = "lang string, bucket long, grams binary, counts binary"


def _longest(bitmaps: list, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b.value, np.uint8) for b in bitmaps]
        sums: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counter in sums.items():
                dealt: dict[int, list[bytes]] = {}
                for gram in counter:
                    dealt.setdefault(crc32(gram) % n_buckets, []).append(gram)
                rows = [(lang, k, b"\n".join(g), np.array([counter[x] for x in g], np.int64).tobytes()) for k, g in dealt.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "bucket", "grams", "counts"])
            sums.clear()

        for lang, walk in _walks(batches):
            length = np.zeros(walk.n, np.int64)
            for k in range(1, LONGEST + 1):
                at = walk.candidates(k, held)
                at = at & _among(walk.hashes(k), held[k - 1]) if len(at) else at
                length[: len(at)] += at
            start = np.flatnonzero(length)
            last = walk.end[start + length[start] - 1]
            data, counter = walk.data, sums.setdefault(lang, Counter())
            counter[b""] += walk.n
            counter.update([data[a:b] for a, b in zip(walk.begin[start].tolist(), last.tolist(), strict=True)])
            if sum(map(len, sums.values())) > HELD_PHRASES:
                yield from out()
        yield from out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums as rows, those of equal phrases added up as far as they are held together."""
    sums: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counter in sums.items():
            grams = pa.array(list(counter), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), grams, pa.array(list(counter.values()), pa.int64())], ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        for row in range(batch.num_rows):
            lang, _, grams, counts = (c[row].as_py() for c in batch.columns)
            counter = sums.setdefault(lang, Counter())
            for gram, n in zip(grams.split(b"\n"), np.frombuffer(counts, np.int64).tolist(), strict=True):
                counter[gram] += n
            if sum(map(len, sums.values())) > HELD_PHRASES:
                yield from out()
    yield from out()


def _first(gram: Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def longest_grams(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, gram, n: how often each phrase is the longest that starts at a place, of four words at most; an empty gram has the number of the
    language's words."""
    texts = pick(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bitmaps, n_frequent = frequent(texts, least, bits)
    n_buckets = 1 + n_frequent // BUCKET_PHRASES
    packed = texts.mapInArrow(_longest(bitmaps, n_buckets), PACKED).repartition("lang", "bucket")
    found = cut(packed.mapInArrow(_merged, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    for b in bitmaps:
        b.unpersist()
    return found


def _chained(links: DataFrame) -> DataFrame:
    """edge, head, place: of each edge (edge, to: the one before it, or itself) the first of its path and its place from there.

    Pointers double until all lead to a first edge. What never gets there goes in a circle, which is cut before its least edge.
    """
    state = cut(links.select("edge", "to", F.when(F.col("edge") == F.col("to"), 0).otherwise(1).cast("long").alias("dist")))
    before = None
    while True:
        ahead = state.select(F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        stepped = cut(state.join(ahead, "to").select("edge", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.col("_dist") > 0).alias("open")))
        left = stepped.filter("open").count()
        forget(state)
        if left == 0:
            return stepped.select("edge", F.col("to").alias("head"), F.col("dist").alias("place"))
        if left == before:
            round_ = stepped.filter("open").select("edge")
            ring = links.join(round_, "edge", "left_semi")
            least = connected(ring.select(F.col("edge").alias("a"), F.col("to").alias("b"))).select("component").distinct()
            opened = links.join(least.select(F.col("component").alias("edge")), "edge", "left_semi").select("edge", F.col("edge").alias("to"))
            links = links.join(opened, "edge", "left_anti").unionByName(opened)
            return _chained(links)
        before, state = left, stepped


def compact_paths(edges: DataFrame) -> DataFrame:
    """lang, words, weights: the graph of edges (lang, gram of four words, n) with unary paths as rows. weights has one number for each four
    words that follow each other; a path of more than PART edges has several rows."""
    named = edges.select(F.concat("lang", F.lit("\n"), "gram").alias("edge"), "lang", "gram", "n")
    ends = named.select("lang", F.substring_index("gram", " ", -3).alias("node"), "edge").groupBy("lang", "node").agg(F.count("*").alias("n_in"), F.min("edge").alias("to"))
    starts = named.select("lang", _first(F.col("gram"), 3).alias("node"), "edge").groupBy("lang", "node").agg(F.count("*").alias("n_out"), F.min("edge").alias("edge"))
    unary = ends.join(starts, ["lang", "node"]).filter("n_in = 1 and n_out = 1").select("edge", "to")
    links = cut(named.select("edge").join(unary, "edge", "left").select("edge", F.coalesce("to", "edge").alias("to")))
    rows = named.join(_chained(links), "edge").withColumn("part", F.expr(f"place div {PART}"))
    along = F.array_sort(F.collect_list(F.struct("place", "gram", "n")))
    paths = rows.groupBy("lang", "head", "part").agg(along.alias("along"))
    first = F.split(_first(F.col("along")[0]["gram"], 3), " ")
    return paths.select("lang", F.concat(first, F.transform("along", lambda e: F.substring_index(e["gram"], " ", -1))).alias("words"), F.transform("along", lambda e: e["n"]).alias("weights"))


def counted(grams: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, k, phrase, f of every phrase that occurs `least` times or more, from the longest grams alone."""
    size = F.when(F.col("gram") == "", 0).otherwise(F.size(F.split("gram", " ")))
    sized = grams.withColumn("k", size)
    heavy = (F.col("k") == LONGEST) & (F.col("n") >= least)
    paths = cut(compact_paths(sized.filter(heavy).select("lang", "gram", "n")))
    edge = F.explode(F.transform("weights", lambda n, i: F.struct(F.array_join(F.slice("words", i + 1, LONGEST), " ").alias("gram"), n.alias("n"))))
    levels = {LONGEST: paths.select("lang", edge.alias("e")).select("lang", F.col("e.gram").alias("gram"), F.col("e.n").alias("n"))}
    light = sized.filter((F.col("k") == LONGEST) & (F.col("n") < least)).select("lang", "gram", "n")
    flow = levels[LONGEST].unionByName(light)
    for k in range(LONGEST - 1, 0, -1):
        ends = sized.filter(F.col("k") == k).select("lang", "gram", "n")
        flow = flow.select("lang", _first(F.col("gram"), k).alias("gram"), "n").unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        levels[k] = flow
    found = None
    for k, level in levels.items():
        own = level.filter(F.col("n") >= least).select("lang", F.lit(k).alias("k"), F.col("gram").alias("phrase"), F.col("n").alias("f"))
        found = own if found is None else found.unionByName(own)
    return found


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases.

    bits: size of the bitmaps, a matter of work alone: the result is the same for any.
    """
    grams = longest_grams(docs, least, bits)
    counts = cut(counted(grams, least))
    phrases = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    inside = [F.when((F.col("k") > size) & (F.col("k") >= size + at - 1), joined(at, size)) for size in (2, 3) for at in range(1, LONGEST - size + 2)]
    within = phrases.filter("k > 2").select("lang", F.explode(F.array_compact(F.array(*inside))).alias("phrase"), "a", "k")
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    stays = F.coalesce(100 * F.col("_longer") < KEEP_PERCENT * F.col("a"), F.lit(True))
    kept = phrases.join(within, ["lang", "phrase"], "left").filter(stays).drop("_longer")
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: j)).alias("cut")
    halves = kept.select("lang", "phrase", "a", "k", "words", cuts).select(
        "lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit("l").alias("side"), joined(1, F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))).alias("half")
    )
    parts = halves.select("lang", "phrase", "a", "cut", "half.side", "half.part")
    known = parts.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    of = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("cut") == c), F.col("f")))
    wide = known.groupBy("lang", "phrase", "a").agg(*[of(s, c).alias(f"{s}{c}") for s in "lr" for c in range(1, LONGEST)])
    score = "cast({s} as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l{c} as decimal(19, 0)) + cast(r{c} as decimal(19, 0)))"
    tried = [F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(score.format(s=SCALE, c=c)).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, LONGEST)]
    scored = wide.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*tried))).alias("best"))
    order = W.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = grams.filter("gram = ''").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


ORACLE_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), p as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from d
), g as (
  select lang, k, ws[i : i + k - 1] as words, count(*) as f
  from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from p), (select unnest([1, 2, 3, 4]) as k)
  where i + k - 1 <= len(ws) group by all
), t as (
  select lang, cast(sum(f) as bigint) as n from g where k = 1 group by lang
), q as (
  select * from g where f >= 30
), c as (
  select lang, k, words, f as a from q where k > 1
), inside as (
  select lang, words[i : i + m - 1] as words, max(a) as longer
  from (select lang, k, words, a, unnest(range(1, k + 1)) as i from c), (select unnest([2, 3]) as m)
  where m < k and i + m - 1 <= k group by all
), kept as (
  select c.* from c left join inside using (lang, words) where longer is null or 100 * longer < 80 * a
), cuts as (
  select lang, k, words, a, unnest(range(1, k)) as j from kept
), s as (
  select c.lang, c.words, a, j, x.f as l, y.f as r, cast((2000000 * cast(a as hugeint)) // (cast(x.f as hugeint) + y.f) as bigint) as score
  from cuts c join q x on x.lang = c.lang and x.words = c.words[1 : j] join q y on y.lang = c.lang and y.words = c.words[j + 1 : c.k]
), b as (
  select lang, array_to_string(words, ' ') as phrase, a, l, r, score from s
  qualify row_number() over (partition by lang, words order by score, j) = 1
), k as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from b
)
select lang, rank, phrase, a, l, r, n, score from k join t using (lang) where rank <= 2000
"""
