"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents whose sets of five-word shingles have a Jaccard similarity of `threshold` or more are linked.
Documents with equal sets form one class and are handled once. MinHash bands give candidates; the
classes that share a band are joined through the band's least class only, so a band of n classes makes
n - 1 rows and never n * n. What hangs together that way is a candidate group. Inside a group all pairs
are compared MinHash value by MinHash value; a pair is dropped as soon as the posterior probability
that it reaches the threshold, given the matches so far, falls below `tolerance`, and the rest are verified on the
shingle sets themselves.

Scale: a group that is larger than a block is first split on MinHash values alone: its classes, of half a kilobyte each,
are compared in pairs of blocks of `sketch_block` rows, and what hangs together by pairs that the pruning leaves is a
group of its own. So groups that only hang together by chains of unlike texts come apart before texts move. What is still
larger than a block are near copies of each other, whose links have to be counted one by one: it is cut into blocks of
bounded size by hash, and every pair of blocks is a task of its own, to which a text is sent once for each block of its group.
Small groups share tasks. Pairs never leave a task: it returns a count of links per class and a spanning forest of them.
Texts move only for classes in candidate groups. Tables that are used twice are written to the shared folder. The
members of candidate groups are sent to all tasks while they are at most `most_sent` rows, and joined by a shuffle beyond.

Recall: bands of `ROWS` values, `BANDS` of them, miss a pair at the threshold with a probability of
about 5e-6, the pruning with less than 1e-6.

Defined cases: a text without words (null, empty, blank) links to nothing and is its own class; a text
of fewer than five words is one shingle; repeated rows are copies of each other; a class's id is its
least doc_id (null if it has none); very long texts are read whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, pieces
from .graph import connected
from .shingles import MinHash, set_key, shingle_set

THRESHOLD = 0.8
TOLERANCE = 1e-7
BANDS, ROWS = 40, 6
COMPARED, STEP = 128, 16
BLOCK = 1_200_000
SKETCH_BLOCK = 4096
ROW_COST = 500
MOST_SENT = 500_000


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n MinHash values with which a pair stays. With a uniform prior the posterior is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its class (key of its shingle set, null without words), the set's size, its bands' keys and its text's hash."""
    hashes = MinHash(BANDS * ROWS)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in pieces(batches, "text"):
        keys, sizes, bands = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text) if text else np.zeros(0, np.uint64)
            sizes.append(len(s))
            if not len(s):
                keys.append(None)
                bands.append([])
                continue
            keys.append(set_key(s))
            h = salt.copy()
            for row in hashes.of(s).reshape(BANDS, ROWS).T:
                h = (h ^ row.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            bands.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "node", "n_shingles", "bands"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, a hash of the text: rows that share an id, or have none, are told apart by it."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.withColumn("text_key", F.xxhash64("text"))


def sketches(docs: DataFrame) -> DataFrame:
    return _keyed(docs).mapInArrow(_sketch, "doc_id long, text_key long, node binary, n_shingles long, bands array<long>")


def classes_of(sketched: DataFrame) -> DataFrame:
    """Per class: node, copies, n_shingles, least_id (doc_id), and of the row that stands for it text_key and n_same, the number of
    rows that have its doc_id and text."""
    rows = sketched.filter("node is not null").groupBy("node", "doc_id", "text_key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key", "n")).alias("least")
    found = rows.groupBy("node").agg(least, F.sum("n").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    return found.select("node", "copies", "n_shingles", F.col("least.doc_id").alias("least_id"), "least.text_key", F.col("least.n").alias("n_same"))


def candidate_groups(sketched: DataFrame) -> DataFrame:
    """node, component: the classes that share a band with another one, grouped by what hangs together."""
    banded = sketched.filter("node is not null").select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last")
    stars = banded.join(hubs.select("band", "hub"), "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return connected(stars.distinct())


class _Forest:
    """Which places hang together so far."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def joined(self, a: int, others: np.ndarray) -> Iterator[int]:
        """Those of others that did not hang together with a, which now do."""
        for b in others.tolist():
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[x] = y
                yield b


class _Dense:
    """Shared shingles of many texts that hold mostly the same ones, as products of 0/1 matrices, a slab of rows at a time."""

    SLAB, MOST, LEAST_FILLED = 256, 1 << 24, 0.02

    def __init__(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.rows, self.left, self.right = rows, left, rows[right]
        self.place = {int(a): k for k, a in enumerate(left)}
        self.slab, self.product = -1, None

    @classmethod
    def of(cls, columns: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, n_columns: int) -> _Dense | None:
        """None where the matrix would be too large, or holds mostly zeros."""
        n = len(bounds) - 1
        common = np.bincount(columns, minlength=n_columns) > 1  # what only one text has is never shared
        kept = common[columns]
        size = n * int(common.sum())
        if len(left) < cls.SLAB or not 0 < size <= cls.MOST or kept.sum() < cls.LEAST_FILLED * size:
            return None
        rows = np.zeros((n, size // n), np.float32)  # sums below 2**24 are exact
        rows[np.repeat(np.arange(n), np.diff(bounds))[kept], (np.cumsum(common) - 1)[columns[kept]]] = 1
        return cls(rows, left, right)

    def shared(self, a: int) -> np.ndarray:
        slab, at = divmod(self.place[a], self.SLAB)
        if slab != self.slab:
            self.slab, self.product = slab, self.rows[self.left[slab * self.SLAB : (slab + 1) * self.SLAB]] @ self.right.T
        return self.product[at].astype(np.int64)


class _Compare:
    """The task of one pair of blocks, or of several small groups."""

    def __init__(self, threshold: float, tolerance: float):
        self.per_mille = round(threshold * 1000)
        self.steps = [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, COMPARED + 1, STEP)]

    def survivors(self, signatures: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each of left: the places in `right` that neither sizes nor MinHash values rule out. Where left and right are
        equal, only later ones."""
        same = left is right
        for i, a in enumerate(left.tolist()):
            live = np.arange(i + 1 if same else 0, len(right))
            other = sizes[right[live]]
            live = live[np.minimum(other, sizes[a]) * 1000 >= self.per_mille * np.maximum(other, sizes[a])]
            matches, done = np.zeros(len(live), np.int64), 0
            for n, least in self.steps:
                if not len(live):
                    break
                matches += (signatures[right[live], done:n] == signatures[a, done:n]).sum(axis=1)
                keep = matches >= least
                live, matches, done = live[keep], matches[keep], n
            if len(live):
                yield a, live

    def pairs(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each of left: the places in right it is linked to. Where left and right are equal, only later ones."""
        sizes = np.array([len(s) for s in sets])
        hashes = MinHash(COMPARED)
        signatures = np.stack([hashes.of(s) for s in sets])
        columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        inside = np.concatenate([columns[bounds[k] : bounds[k + 1]] for k in right])
        starts = np.concatenate(([0], np.cumsum(sizes[right])[:-1]))
        n_columns = int(columns.max()) + 1
        mark = np.zeros(n_columns, np.int32)
        dense = _Dense.of(columns, bounds, left, right, n_columns)
        for a, live in self.survivors(signatures, sizes, left, right):
            own = columns[bounds[a] : bounds[a + 1]]
            mark[own] = 1
            if dense is not None:
                shared = dense.shared(a)[live]
            elif len(live) * 4 > len(right):
                shared = np.add.reduceat(mark[inside], starts)[live]
            else:
                shared = np.array([mark[columns[bounds[k] : bounds[k + 1]]].sum() for k in right[live]])
            mark[own] = 0
            union = sizes[a] + sizes[right[live]] - shared
            hit = live[shared * 1000 >= self.per_mille * union]
            if len(hit):
                yield a, right[hit]

    def __call__(self, table: pa.Table) -> pa.Table:
        rows = table.select(["node", "component", "block", "first", "second", "copies", "text"]).to_pylist()
        groups: dict[bytes, list[dict]] = {}
        for r in rows:
            groups.setdefault(r["component"], []).append(r)
        nodes, others, links = [], [], []
        for own in groups.values():
            sets = [shingle_set(r.pop("text")) for r in own]
            block = np.array([r["block"] for r in own])
            first, second = own[0]["first"], own[0]["second"]
            left = np.flatnonzero(block == first)
            right = left if first == second else np.flatnonzero(block == second)
            if not len(left) or not len(right):
                continue
            copies = np.array([r["copies"] for r in own])
            count = np.zeros(len(own), np.int64)
            forest = _Forest(len(own))
            for a, hit in self.pairs(sets, left, right):
                count[a] += copies[hit].sum()
                count[hit] += copies[a]
                for b in forest.joined(a, hit):
                    nodes.append(own[a]["node"])
                    others.append(own[b]["node"])
                    links.append(0)
            for k in np.flatnonzero(count).tolist():
                nodes.append(own[k]["node"])
                others.append(None)
                links.append(int(count[k]))
        return pa.table(
            [pa.array(nodes, pa.binary()), pa.array(others, pa.binary()), pa.array(links, pa.int64())],
            names=["node", "other", "links"],
        )


def _texts_of(docs: DataFrame, placed: DataFrame, most_sent: int) -> DataFrame:
    """placed (least_id, text_key, n_same and others, one row a class) with the text of each: one row a class, however many
    rows of docs share its id or its text. Rows of placed are numbers and keys of 16 bytes, so most_sent bounds what is sent."""
    if placed.count() <= most_sent:
        placed = F.broadcast(placed)
    texts = _keyed(docs).withColumnRenamed("text_key", "_key")
    same = texts["doc_id"].eqNullSafe(placed["least_id"]) & (texts["_key"] == placed["text_key"])
    columns = [c for c in placed.columns if c not in ("least_id", "text_key", "n_same")]
    found = texts.join(placed, same).select(*columns, "n_same", "text")
    if placed.filter("n_same > 1").isEmpty():
        return found.drop("n_same")
    once = found.filter("n_same > 1").groupBy(*columns).agg(F.min("text").alias("text"))
    return found.filter("n_same = 1").drop("n_same").unionByName(once)


def _block_pairs(n_blocks, block):
    """For each block of a group: the pair it makes with `block`, the lesser first."""
    return F.transform(
        F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda j: F.struct(F.least(block, j).alias("first"), F.greatest(block, j).alias("second"))
    )


def _split(docs: DataFrame, members: DataFrame, threshold: float, tolerance: float, most_sent: int, sketch_block: int) -> DataFrame:
    """members of large groups, regrouped by what hangs together by pairs that their MinHash values leave."""
    n = members.groupBy("component").agg(F.ceil(F.count("*") / sketch_block).alias("n_blocks"))
    placed = members.join(n, "component").select("node", "component", "least_id", "text_key", "n_same", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).alias("block"))
    compare = _Compare(threshold, tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(COMPARED)
        for batch in pieces(batches, "text"):
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            kept = batch.select(["node", "component", "n_blocks", "block"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([hashes.of(s).tobytes() for s in sets], pa.binary())],
                [*kept.schema.names, "size", "signature"],
            )

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        signatures = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows])
        sizes, block = (np.array([r[c] for r in rows]) for c in ("size", "block"))
        left = np.flatnonzero(block == rows[0]["first"])
        right = left if rows[0]["first"] == rows[0]["second"] else np.flatnonzero(block == rows[0]["second"])
        forest, a_of, b_of = _Forest(len(rows)), [], []
        for a, live in compare.survivors(signatures, sizes, left, right):
            for b in forest.joined(a, right[live]):
                a_of.append(rows[a]["node"])
                b_of.append(rows[b]["node"])
        return pa.table([pa.array(a_of, pa.binary()), pa.array(b_of, pa.binary())], names=["a", "b"])

    signed = _texts_of(docs, placed, most_sent).mapInArrow(sign, "node binary, component binary, n_blocks long, block long, size long, signature binary")
    dealt = signed.withColumn("pair", F.explode(_block_pairs(F.col("n_blocks"), F.col("block")))).select(
        "node", "component", "block", "size", "signature", "pair.first", "pair.second"
    )
    pairs = dealt.groupBy("component", "first", "second").applyInArrow(run, "a binary, b binary")
    return connected(pairs).join(members.drop("component"), "node")


def _verified(docs: DataFrame, members: DataFrame, threshold: float, tolerance: float, most_sent: int, block: int) -> DataFrame:
    """node, other (an edge of the spanning forest, or null), links (documents linked to the node in one task)."""
    cost = members.groupBy("component").agg(F.sum(F.col("n_shingles") + ROW_COST).alias("cost"))
    totals = cost.agg(F.sum(F.when(F.col("cost") <= block, F.col("cost"))).alias("small")).first()
    n_small = 1 + int((totals["small"] or 0) // block)
    n_blocks = F.ceil(F.col("cost") / block)
    placed = members.join(cost, "component").select(
        "node",
        "component",
        "copies",
        "least_id",
        "text_key",
        "n_same",
        n_blocks.alias("n_blocks"),
        F.pmod(F.xxhash64("node"), n_blocks).alias("block"),
    )
    held = _texts_of(docs, placed, most_sent)
    tasks = _block_pairs(F.col("n_blocks"), F.col("block"))
    dealt = held.withColumn("pair", F.explode(tasks)).select(
        "node", "component", "copies", "text", "block", "pair.first", "pair.second",
        F.when(F.col("n_blocks") == 1, F.concat_ws(":", F.lit("small"), F.pmod(F.xxhash64("component"), F.lit(n_small)).cast("string")))
        .otherwise(F.concat_ws(":", F.hex("component"), F.col("pair.first").cast("string"), F.col("pair.second").cast("string")))
        .alias("task"),
    )
    compare = _Compare(threshold, tolerance)

    def run(table: pa.Table) -> pa.Table:
        return compare(table)

    return dealt.groupBy("task").applyInArrow(run, "node binary, other binary, links long")


def join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    most_sent: int = MOST_SENT,
    block: int = BLOCK,
    sketch_block: int = SKETCH_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Two frames. Per document: doc_id, node (its class of equal shingle sets). Per class: node, component, class_id (least doc_id
    of all documents that hang together by links), least_id (of its own), copies (documents in the class), links (other documents linked
    to each of its documents, copies included)."""
    sketched = cut(sketches(docs))
    classes = cut(classes_of(sketched))
    members = cut(candidate_groups(sketched).join(classes, "node"))
    cost = members.groupBy("component").agg(F.sum(F.col("n_shingles") + ROW_COST).alias("cost"))
    large = cost.filter(F.col("cost") > block).select("component")
    if not large.isEmpty():
        parts = _split(docs, members.join(large, "component", "left_semi"), threshold, tolerance, most_sent, sketch_block)
        members = cut(members.join(large, "component", "left_anti").unionByName(parts.select(*members.columns)))
    found = cut(_verified(docs, members, threshold, tolerance, most_sent, block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = classes.join(groups, "node", "left").join(links, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "least_id", "copies", F.coalesce("links", F.lit(0)).alias("links")
    )
    ids = labelled.groupBy("component").agg(F.min("least_id").alias("class_id"))
    per_class = labelled.join(ids, "component").select(
        "node", "component", "class_id", "least_id", "copies", (F.col("links") + F.col("copies") - 1).alias("links")
    )
    return sketched.select("doc_id", "node"), per_class


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links (other documents that reach the threshold with it, copies included), n_copies
    (documents of an equal set, itself included) of every document."""
    documents, classes = join(docs, **options)
    return documents.join(classes, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of linked ones: the one of least doc_id, and of several such rows with equal words
    the one whose columns as JSON come first. Texts without words all stay.

    Texts move once, to the decision on their doc_id; only rows that share a doc_id are hashed again."""
    documents, classes = join(docs, **options)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    stays = (
        classes.filter(F.col("least_id").eqNullSafe(F.col("class_id")))
        .groupBy("component")
        .agg(F.min("node").alias("node"), F.max(name("class_id")).alias("_id"))
        .select("_id", "node", F.lit(True).alias("_first"))
    )
    each = documents.select(name("doc_id").alias("_id"), "node").join(stays, ["_id", "node"], "left")
    stay = F.col("node").isNull() | F.coalesce("_first", F.lit(False))
    decided = cut(each.groupBy("_id").agg(F.count("*").alias("_n"), F.max(stay).alias("_stay")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(name("doc_id").alias("_id"), "text", F.struct(*columns).alias("row"))
    out = packed.join(decided.filter("_n = 1 and _stay").select("_id").hint("merge"), "_id", "left_semi")
    repeated = decided.filter("_n > 1").select("_id")
    if not repeated.isEmpty():

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                sets = [shingle_set(x.encode()) if x else () for x in batch.column("text").to_pylist()]
                nodes = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "node"])

        rows = packed.join(repeated, "_id", "left_semi")
        keyed = rows.mapInArrow(run, rows.withColumn("node", F.lit(None).cast("binary")).schema)
        one = keyed.join(stays, ["_id", "node"], "left_semi").groupBy("_id", "node").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.select("row").unionByName(keyed.filter("node is null").select("row")).unionByName(one.select("row"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct rid, array_to_string(list_slice(ws, k, k + 4), ' ') as w
  from (select rid, ws, unnest(range(1, greatest(2, len(ws) - 3))) as k from d where len(ws) > 0)
), n as (
  select rid, count(*) as size from s group by rid
), c as (
  select a.rid as x, b.rid as y, count(*) as shared from s a join s b on a.w = b.w and a.rid <> b.rid group by a.rid, b.rid
), l as (
  select x, y, shared = p.size and shared = q.size as equal from c join n p on p.rid = x join n q on q.rid = y
  where shared * 1000 >= 800 * (p.size + q.size - shared)
), r(x, y) as (
  select rid, rid from d union select r.x, l.y from r join l on r.y = l.x
), g as (
  select r.x, min(d.doc_id) as class_id from r join d on d.rid = r.y group by r.x
), k as (
  select x, count(*) as n_links, sum(cast(equal as int)) as n_equal from l group by x
)
select d.doc_id, g.class_id, coalesce(n_links, 0) as n_links, cast(coalesce(n_equal, 0) + 1 as bigint) as n_copies
from d join g on g.x = d.rid left join k on k.x = d.rid
"""
