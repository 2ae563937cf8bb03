"""Merkle dataset manifest: a tree of digests per language, one over the languages, and every row's proof.

A leaf is the digest of a document's fields. The leaves of a language ascend by doc_id; 8 consecutive nodes become
their digest until one is left, its subroot; the subroots, ordered by language, give the root likewise. A tree
is cut into superblocks of 8**LEVELS consecutive nodes. On the way up each superblock is reduced to its top, and the tops
are the nodes of the next layer. On the way down nodes are cogrouped by superblock with what the superblock needs from
outside, the siblings on the way from its top to the root: one task finishes the superblock's own reduction, joins the
inner and the outer part of each proof and folds it.

Scale: texts are hashed where they are read and never move; only digests do. Places in the order come from a
sort by ranges with a prefix sum over their sizes, so a language of any size is sorted by many tasks. A group
has one superblock's nodes and one row from outside (7 digests a level), whatever the number of rows; a layer is
8**LEVELS times smaller than the one below. Layers are written to the shared folder. The trees of all languages are
built at once, and nothing is gathered in the driver.

Defined cases: a null field is `-`; a null doc_id comes before all others and is not tampered with; rows of one
doc_id are ordered by their leaves, and equal rows are leaves of their own; a null language is a language of its own,
before all others; a lone leaf is its own subroot and a lone subroot the root; a leaf without siblings has the digest
of nothing as proof; very long texts are hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, pick

FAN = 8
#: Levels of a superblock.
LEVELS = 3
#: Rows of one range of the sort, about.
RANGE_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _written(value: Column) -> Column:
    as_text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language, with null as the empty key), digest (the leaf) and tampered (the leaf of the
    tampered row, null for the others)."""
    own = pick(docs, *FIELDS)
    head = [_written(F.col(c)) for c in FIELDS[:-1]]
    digest = F.sha2(F.concat(*head, _written(F.col("text"))), 256)
    tampered = F.sha2(F.concat(*head, _written(F.translate("text", UPPER, LOWER))), 256)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return own.select("doc_id", tree.alias("tree"), digest.alias("digest"), F.when(chosen, tampered).alias("tampered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, the place (from 0) in their tree, and n, the number of the tree's rows."""
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    n_ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    ranged = cut(rows.repartitionByRange(n_ranges, "tree", *order, "_row").withColumn("_range", F.spark_partition_id()))
    in_tree = W.partitionBy("tree")
    ahead = F.sum("_size").over(in_tree.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sizes = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("tree", "_range", F.coalesce(ahead, F.lit(0)).alias("_start"), F.sum("_size").over(in_tree).alias("n"))
    within = F.row_number().over(W.partitionBy("tree", "_range").orderBy(*order, "_row")) - 1
    joined = ranged.withColumn("_within", within).join(starts, ["tree", "_range"])
    return joined.withColumn("pos", F.col("_start") + F.col("_within")).drop("_row", "_range", "_start", "_within")


def _reduced(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of one superblock of a tree of n nodes, from its nodes to its top."""
    found = [digests]
    if n <= FAN**levels:  # the only superblock: up to the tree's root
        levels = 0
        while FAN**levels < n:
            levels += 1
    for _ in range(levels):
        below = found[-1]
        found.append([_h("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return found


def _siblings(level: list[str], k: int) -> tuple[str, str]:
    first = k - k % FAN
    return "".join(level[first:k]), "".join(level[k + 1 : first + FAN])


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**levels}"))


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The layers of the trees of nodes (tree, pos, n, digest), from the nodes to layers of one node per tree."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        digest = _reduced(rows.sort_values("pos")["digest"].tolist(), n, levels)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // FAN**levels)], "digest": [digest]})

    layers = [nodes]
    while True:
        grouped = _blocks(layers[-1].select("tree", "pos", "n", "digest"), levels).groupBy("tree", "block")
        layers.append(cut(grouped.applyInPandas(top, "tree string, pos long, n long, digest string")))
        if layers[-1].filter("n > 1").isEmpty():
            return layers


OUTER = "tree string, block long, before array<string>, after array<string>, subroot string, root string"


def descend(layers: list[DataFrame], outer: DataFrame, result: Callable[[dict, list, list, dict], dict], schema: str, levels: int = LEVELS) -> DataFrame:
    """result(node, before, after, outer) of every node of the lowest layer; before and after are its siblings, joined, level by level up
    to the root. outer is a row of OUTER for each tree's top."""

    def meet(made: Callable[[dict, list, list, dict], dict], columns: list[str]):
        def run(key: tuple, inner: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
            inner = inner.sort_values("pos")
            own = _reduced(inner["digest"].tolist(), int(inner["n"].iloc[0]), levels)
            above = outside.iloc[0].to_dict()
            before_top, after_top = list(above["before"]), list(above["after"])
            rows = []
            for k, node in enumerate(inner.to_dict("records")):
                before, after = [], []
                for level in own[:-1]:
                    b, a = _siblings(level, k)
                    before.append(b)
                    after.append(a)
                    k //= FAN
                rows.append(made(node, before + before_top, after + after_top, above))
            return pd.DataFrame(rows, columns=columns)

        return run

    def hand_down(node: dict, before: list, after: list, above: dict) -> dict:
        return {"tree": node["tree"], "block": node["pos"], "before": before, "after": after, "subroot": above["subroot"], "root": above["root"]}

    names = lambda text: [c.split()[0] for c in text.split(", ")]
    for layer in reversed(layers[1:-1]):
        met = _blocks(layer, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        outer = cut(met.applyInPandas(meet(hand_down, names(OUTER)), OUTER))
    met = _blocks(layers[0], levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return met.applyInPandas(meet(result, names(schema)), schema)


def fold(digest: str, before: list[str], after: list[str]) -> str:
    """The root that a digest and its siblings give."""
    for b, a in zip(before, after, strict=True):
        digest = _h(b + digest + a)
    return digest


def _checked(node: dict, before: list, after: list, above: dict) -> dict:
    folded = fold(node["tampered"] or node["digest"], before, after)
    return {
        "doc_id": node["doc_id"],
        "leaf": node["digest"],
        "subroot": above["subroot"],
        "root": above["root"],
        "proof_sha256": _h("".join(b + a for b, a in zip(before, after, strict=True))),
        "folded_root": folded,
        "verified": folded == above["root"],
    }


def _crowned(node: dict, before: list, after: list, above: dict) -> dict:
    return {"tree": node["name"], "block": 0, "before": before, "after": after, "subroot": node["digest"], "root": above["root"]}


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    levels: of a superblock; a matter of layout alone, the result is the same for any.
    """
    nodes = cut(placed(leaves(docs), "doc_id", "digest"))
    layers = climb(nodes, levels)
    subroots = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    crown = climb(cut(placed(subroots, "name")), levels)
    nothing = F.expr("cast(array() as array<string>)")
    top = crown[-1].select("tree", F.lit(0).cast("long").alias("block"), nothing.alias("before"), nothing.alias("after"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    outer = cut(descend(crown, top, _crowned, OUTER, levels))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(layers, outer, _checked, schema, levels)


#: crc32 by bits, every level of every tree in one recursive table, and each row's way up in another.
ORACLE_SQL = r"""
with recursive f as (
  select doc_id, lang, text,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
    list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1),
        lambda k: ascii(substr(cast(doc_id as varchar), k, 1))::ubigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::ubigint)),
        lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))) as crc
  from documents
), d as (
  select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when xor(crc, 4294967295::ubigint) % 3 = 0 then sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as tampered
  from f
), p as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n,
    coalesce('=' || lang, '') as tree
  from d
), t(tree, level, pos, n, digest) as (
  select tree, 0, pos, n, leaf from p
  union all
  select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from t where n > 1
  group by tree, level, pos // 8, n
), s as (
  select tree, level as height, digest as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from t where n = 1
), u(level, pos, n, digest) as (
  select 0, pos, n, subroot from s
  union all
  select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from u where n > 1
  group by level, pos // 8, n
), nodes as (
  select tree, level, pos, digest from t where n > 1 union all select '*', level, pos, digest from u where n > 1
), sides as (
  select a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos), '') as before,
    coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos), '') as after
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.pos // 8 = b.pos // 8
  group by a.tree, a.level, a.pos
), way(doc_id, leaf, tree, crown, step, pos, proof, folded, height) as (
  select doc_id, leaf, p.tree, s.pos, 0, p.pos, '', coalesce(tampered, leaf), s.height from p join s on p.tree = s.tree
  union all
  select w.doc_id, w.leaf, w.tree, w.crown, w.step + 1, case when w.step + 1 = w.height then w.crown else w.pos // 8 end,
    proof || before || after, sha256(before || folded || after), w.height
  from (select *, case when step = height and step <> 0 then crown when height = 0 and step = 0 then crown else pos end as at from way) w
  join sides x on x.tree = case when w.step < w.height then w.tree else '*' end
    and x.level = case when w.step < w.height then w.step else w.step - w.height end and x.pos = w.at
)
select w.doc_id, w.leaf, s.subroot, r.digest as root, sha256(w.proof) as proof_sha256, w.folded as folded_root, w.folded = r.digest as verified
from way w join s on s.tree = w.tree, (select digest, level from u where n = 1) r
where w.step = s.height + r.level
"""
