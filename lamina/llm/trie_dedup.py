"""Exact duplicates with Patricia-trie owners.

Texts are equal when they are identical after each run of ASCII white space became one space. Full byte strings
are inserted into compressed radix tries; where a text ends, its terminal node keeps an owner (the key of the first row that
came there), the least identifier and the number of rows.

1. Every task puts the texts that it reads into a trie of its own, so copies within a task meet before anything moves. Each
   row learns its local owner; each terminal becomes one row with its text.
2. The terminals are dealt out by length and hash of content, so equal texts meet, and each partition puts them into a
   trie again. Each local owner learns its final one, each final terminal gives the group's least identifier and size.
3. Rows are joined with what their local owners learned.

A trie that outgrows its budget spills by subtree, the largest first. In step 1 the subtree's terminals simply go out; a
later copy makes a second one. In step 2 the subtree leaves a mark in the trie, all its texts, those that come later too, are
written to the shared folder, and the next round deals them out anew.

Scale: the text of a row moves once, and only one of each task's copies; a group of copies that holds a third of all rows
is one text a task, and in the joins it is spread over the tasks' local owners. A task holds the budget's bytes and one text.
The number of partitions follows the bytes of the terminals. The terminals, with their texts, are written once.

Defined cases: a null text is an empty text; the least identifier is the least doc_id, null last, and of several such
rows the one read first, which alone is kept; repeated rows are copies; very long texts are inserted whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, pieces, text_or_empty

#: Bytes of labels and nodes that a task's trie may hold.
BUDGET = 48 << 20
#: Bytes of terminals in one partition of step 2, about.
PARTITION_BYTES = 16 << 20
NODE_BYTES = 300


class Terminal:
    """What is known of one text: its owner, the least (without id, doc_id, row), the number of rows, length and hash."""

    __slots__ = ("count", "hash", "least", "length", "owner")

    def __init__(self, owner: int, least: tuple, count: int, length: int, hashed: int):
        self.owner, self.least, self.count, self.length, self.hash = owner, least, count, length, hashed

    def row(self, kind: str, text: bytes) -> tuple:
        without, least_id, least_row = self.least
        return kind, self.owner, self.owner, None if without else least_id, least_row, self.count, self.length, self.hash, text


class Node:
    __slots__ = ("end", "kids", "label", "spilled")

    def __init__(self, label: bytes):
        self.label, self.kids, self.end, self.spilled = label, {}, None, False


class Trie:
    """A compressed radix trie over bytes: a node's label leads to it, and siblings differ in the first byte."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held = 0

    def place(self, text: bytes) -> Node:
        """The node where text ends, made if needed; or the mark of a spilled subtree that it would be in."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.held += len(kid.label) + NODE_BYTES
                return kid
            label = kid.label
            if not text.startswith(label, at):
                kid = self._split(node, kid, self._shared(label, text, at))
            at += len(kid.label)
            if kid.spilled:
                return kid
            node = kid
        return node

    @staticmethod
    def _shared(label: bytes, text: bytes, at: int) -> int:
        """How many leading bytes label shares with text[at:], of which it isn't a prefix: by halving."""
        low, high = 1, min(len(label), len(text) - at) + 1
        while high - low > 1:
            middle = (low + high) // 2
            if text.startswith(label[:middle], at):
                low = middle
            else:
                high = middle
        return low

    def _split(self, parent: Node, kid: Node, shared: int) -> Node:
        upper = Node(kid.label[:shared])
        kid.label = kid.label[shared:]
        upper.kids[kid.label[0]] = kid
        parent.kids[upper.label[0]] = upper
        self.held += NODE_BYTES
        return upper

    def terminals(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Terminal]]:
        """The texts at and below node, which prefix (its own label included) leads to."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.end is not None:
                yield prefix, node.end
            stack.extend((kid, prefix + kid.label) for kid in node.kids.values())

    def _sizes(self) -> dict[int, int]:
        """Bytes held in each subtree, by the node's id."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids.values())
        sizes: dict[int, int] = {}
        for node in reversed(order):
            sizes[id(node)] = len(node.label) + NODE_BYTES + sum(sizes[id(k)] for k in node.kids.values())
        return sizes

    def cut_largest(self, mark: bool) -> list[tuple[bytes, Terminal]]:
        """Take out the largest subtree that leaves a text in the trie (none if there is none to take): from the root
        down while a node has one open child and no text of its own. With mark, a stub stays in its place."""
        sizes = self._sizes()
        node, prefix = self.root, b""
        while True:
            below = [k for k in node.kids.values() if not k.spilled]
            if node.end is not None or len(below) != 1:
                break
            node = below[0]
            prefix += node.label
        if not below:
            return []
        kid = max(below, key=lambda k: sizes[id(k)])
        found = list(self.terminals(kid, prefix + kid.label))
        self.held -= sizes[id(kid)]
        if mark:
            stub = Node(kid.label)
            stub.spilled = True
            node.kids[kid.label[0]] = stub
            self.held += len(stub.label) + NODE_BYTES
        else:
            del node.kids[kid.label[0]]
        return found


_FIELDS = [("kind", pa.string()), *[(c, pa.int64()) for c in ("member", "owner", "least_id", "least_row", "n", "length", "hash")], ("text", pa.binary())]
SCHEMA = "kind string, member long, owner long, least_id long, least_row long, n long, length long, hash long, text binary"
CARRIED = ("member", "least_id", "least_row", "n", "length", "hash", "text")


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=pa.schema(_FIELDS))


def owners(final: bool, budget: int):
    """A function for mapInArrow over rows of the columns CARRIED. It returns rows of three kinds: a `member` says to which
    owner a row came, with its own least_id; a `terminal` is a text's owner with what is known of it, in the local step with the text, in the
    final one with the text's digest; a `spilled` row of the final step has to come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        rows: list[tuple] = []
        waiting = 0

        def full() -> bool:
            return waiting > 4 << 20 or len(rows) >= 20_000

        for batch in pieces(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in CARRIED]
            for member, least_id, least_row, n, length, hashed, text in zip(*columns, strict=True):
                node = trie.place(text)
                if node.spilled:
                    rows.append(("spilled", member, None, least_id, least_row, n, length, hashed, text))
                    waiting += length
                else:
                    least = (least_id is None, least_id or 0, least_row)
                    if node.end is None:
                        node.end = Terminal(member, least, n, length, hashed)
                    else:
                        node.end.least = min(node.end.least, least)
                        node.end.count += n
                    rows.append(("member", member, node.end.owner, least_id, *[None] * 5))
                while trie.held > budget and (spilt := trie.cut_largest(mark=final)):
                    for whole, t in spilt:
                        rows.append(t.row("spilled" if final else "terminal", whole))
                        waiting += len(whole)
                        if full():
                            yield _emit(rows)
                            rows, waiting = [], 0
                if full():
                    yield _emit(rows)
                    rows, waiting = [], 0
        for whole, t in trie.terminals(trie.root, b""):
            rows.append(t.row("terminal", hashlib.sha256(whole).hexdigest().encode() if final else whole))
            waiting += len(whole)
            if full():
                yield _emit(rows)
                rows, waiting = [], 0
        if rows:
            yield _emit(rows)

    return run


def duplicates(docs: DataFrame, budget: int = BUDGET, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 of every row.

    budget: bytes that the trie of one task may hold; partition_bytes: bytes of texts dealt to one partition. Both are matters of
    memory alone, the groups are the same for any.
    """
    normal = F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", " ").cast("binary")
    row = F.monotonically_increasing_id()
    read = pick(docs, "doc_id", "text").select(row.alias("member"), F.col("doc_id").cast("long").alias("least_id"), row.alias("least_row"), F.lit(1).cast("long").alias("n"), normal.alias("text"))
    read = read.select("member", "least_id", "least_row", "n", F.length("text").cast("long").alias("length"), F.xxhash64("text").alias("hash"), "text")
    local = cut(read.mapInArrow(owners(False, budget), SCHEMA))
    rows = local.filter("kind = 'member'").select(F.col("least_id").alias("doc_id"), F.col("member").alias("row"), F.col("owner").alias("local"))
    left, rounds = local.filter("kind = 'terminal'").select(*CARRIED), []
    while not rounds or not left.isEmpty():
        size = left.agg(F.sum(F.col("length") + NODE_BYTES)).first()[0] or 0
        dealt = left.repartition(max(1, math.ceil(size / partition_bytes)), "length", "hash", F.lit(len(rounds)))
        rounds.append(cut(dealt.mapInArrow(owners(True, budget), SCHEMA)))
        left = rounds[-1].filter("kind = 'spilled'").select(*CARRIED)
    came = [r.filter("kind = 'member'").select("member", F.col("owner").alias("_next")) for r in rounds]
    learned = came[0].select(F.col("member").alias("local"), F.col("_next").alias("owner"))
    for k, step in enumerate(came[1:]):  # texts that were spilled: what they came to in the next round
        if k == 0:  # a row that met a stub at once has no member row yet
            learned = learned.unionByName(rounds[0].filter("kind = 'spilled' and owner is null").select(F.col("member").alias("local"), F.col("member").alias("owner")))
        learned = learned.join(step, learned["owner"] == step["member"], "left").select("local", F.coalesce("_next", "owner").alias("owner"))
    whole = reduce(DataFrame.unionByName, [r.filter("kind = 'terminal'") for r in rounds])
    groups = whole.select("owner", F.col("least_id").alias("keep_id"), "least_row", F.col("n").alias("group_size"), F.col("text").cast("string").alias("text_sha256"))
    known = learned.join(groups, "owner").drop("owner")
    return rows.join(known, "local").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("least_row")).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as normal from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by normal order by doc_id nulls last) = 1 as kept, sha256(normal) as text_sha256
from d
window g as (partition by normal)
"""
