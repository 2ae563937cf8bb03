"""The manifest, the tries, the phrase graph, and texts that share an id in the n-gram join, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import collocations, merkle_manifest, ngram_join, trie_dedup

from .conftest import DOCS


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def way_up(nodes):
    """The root of nodes, and of each node its siblings level by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            first = k - k % 8
            ways[leaf].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 8])))
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], ways


def manifest_by_hand(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    lower = str.maketrans(merkle_manifest.UPPER, merkle_manifest.LOWER)

    def leaf(r, text):
        return h("".join(map(written, (r[0], r[3], r[2], r[4], text))))

    langs = defaultdict(list)
    for r in rows:
        chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        changed = leaf(r, r[1].translate(lower) if r[1] is not None else None) if chosen else None
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), changed, r[0]))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for name in names:
        langs[name].sort(key=lambda x: x[:3])
        tops[name] = way_up([x[2] for x in langs[name]])
    root, crown = way_up([tops[x][0] for x in names])
    out = []
    for k, name in enumerate(names):
        subroot, ways = tops[name]
        for (_, _, own, changed, doc_id), way in zip(langs[name], ways, strict=True):
            folded = changed or own
            for before, after in way + crown[k]:
                folded = h(before + folded + after)
            out.append((doc_id, own, subroot, root, h("".join(b + a for b, a in way + crown[k])), folded, folded == root))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_brute_force(spark, odd, levels):
    docs = spark.createDataFrame([(k, f"Text {k % 40}", random.Random(k).choice(["en", "de", None, "", "x"]) if k < 150 else "en", "s", k) for k in range(200)], DOCS).union(odd)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert by_text(merkle_manifest.manifest(docs.repartition(5), levels).collect()) == by_text(manifest_by_hand(rows))


def test_manifest_on_odd_rows(clashing, empty, odd):
    assert by_text(merkle_manifest.manifest(clashing).collect()) == by_text(merkle_manifest.manifest(odd).collect())
    assert merkle_manifest.manifest(empty).count() == 0
    lone = merkle_manifest.manifest(odd.filter("doc_id = 3")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == h("")


@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=40))
def test_trie_holds_what_was_put_in(texts):
    trie = trie_dedup.Trie()
    for k, text in enumerate(texts):
        node = trie.place(text)
        if node.end is None:
            node.end = trie_dedup.Terminal(k, (False, k, k), 0, len(text), 0)
        node.end.count += 1
    found = {text: (t.owner, t.count) for text, t in trie.terminals(trie.root, b"")}
    assert found == {t: (texts.index(t), texts.count(t)) for t in set(texts)}


@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=2, max_size=20), st.booleans())
def test_a_spilled_subtree_is_whole(texts, mark):
    trie = trie_dedup.Trie()
    for k, text in enumerate(sorted(texts)):
        trie.place(text).end = trie_dedup.Terminal(k, (False, k, k), 1, len(text), 0)
    gone = {text for text, _ in trie.cut_largest(mark)}
    left = {text for text, _ in trie.terminals(trie.root, b"")}
    assert gone and left and gone | left == texts and not gone & left
    if mark:
        assert all(trie.place(text).spilled for text in gone)
        assert not any(trie.place(text).spilled for text in left)


def copies_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[ \t-\r]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, h(text)) for k, i in enumerate(ids)]
    return out


@pytest.mark.parametrize("budget,partition_bytes", [(1 << 20, 1 << 20), (3000, 2000), (900, 1000)])
def test_copies_against_brute_force(spark, budget, partition_bytes):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab") * rng.randint(0, 12) + rng.choice(["", "x", "yy"])) for k in range(400)]
    rows += [(None, None), (None, " "), (3, "a\t\nb"), (3, "a b"), (7, "a" * 50_000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert by_text(trie_dedup.duplicates(docs, budget, partition_bytes).collect()) == by_text(copies_by_hand(rows))


def test_copies_on_odd_rows(clashing, empty, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert by_text(trie_dedup.duplicates(clashing).collect()) == by_text(copies_by_hand(rows))
    assert trie_dedup.duplicates(empty).count() == 0


def phrases_by_hand(rows, least, top):
    """rows: lang, text."""
    counts, n = defaultdict(Counter), Counter()
    lower = str.maketrans(merkle_manifest.UPPER, merkle_manifest.LOWER)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def phrase_rows():
    rng = random.Random(4)
    words = ["a", "B", "c", "dé", "e"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(60))) for _ in range(40)]
    ring = ("en", "r s t u v " * 9)  # a circle of unary nodes
    long = ("de", " ".join(f"w{k}" for k in range(70)))  # one path
    same = ("de", "z " * 30)
    return rows + [ring, long, same] * 4 + [(None, None), ("en", ""), ("fr", "alone")]


@pytest.mark.parametrize("least,bits,top", [(3, 26, 2000), (3, 16, 40), (5, 20, 7)])
def test_phrases_against_brute_force(spark, monkeypatch, least, bits, top):
    monkeypatch.setattr(collocations, "PART", 16)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 300)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.collocations(docs, least, top, bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert by_text(got.collect()) == by_text(phrases_by_hand(rows, least, top))


def test_paths_are_compacted(spark):
    edges = spark.createDataFrame([("en", " ".join(f"w{j}" for j in range(k, k + 4)), 5) for k in range(20)] + [("en", "p q r s", 2), ("en", "q r s p", 2), ("en", "r s p q", 2), ("en", "s p q r", 2)], "lang string, gram string, n long")
    paths = sorted((len(r.words), len(r.weights)) for r in collocations.compact_paths(edges).collect())
    assert paths == [(7, 4), (23, 20)]


def test_phrases_on_odd_rows(clashing, empty, odd):
    found = collocations.collocations(odd, 3).collect()
    assert by_text(collocations.collocations(clashing, 3).collect()) == by_text(found)
    assert by_text(found) == by_text(phrases_by_hand([(r.lang, r.text) for r in odd.collect()], 3, 2000))
    assert collocations.collocations(empty).count() == 0


def test_texts_that_share_an_id_are_sent_once(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    rows = [(None if k % 2 else 7, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(90)] + [(None, "one text of many equal rows")] * 30
    sent = []
    texts_of = ngram_join._texts_of

    def counted(*given):
        found = texts_of(*given)
        sent.append((given[1].count(), found.count()))
        return found

    monkeypatch.setattr(ngram_join, "_texts_of", counted)
    found = ngram_join.report(spark.createDataFrame(rows, "doc_id long, text string"), block=20_000).groupBy("n_links", "n_copies").count().collect()
    assert sent and all(classes == texts for classes, texts in sent)
    assert {tuple(r) for r in found} == {(89, 1, 90), (29, 30, 30)}


def test_equal_rows_stand_for_their_class_once(spark):
    rows = [(1, "some words that are all the same here and there"), (1, "some words that are all the same here and there")] * 20
    near = [(2, "some words that are all the same here and there too")]
    classes = ngram_join.classes_of(ngram_join.sketches(spark.createDataFrame(rows + near, "doc_id long, text string"))).orderBy("copies").collect()
    assert [(r.copies, r.least_id, r.n_same) for r in classes] == [(1, 2, 1), (40, 1, 40)]


def test_shared_counts_by_products(monkeypatch):
    rng = random.Random(3)
    sets = [" ".join(rng.choice(["a", "b"]) + str(k) for k in range(60)).encode() for _ in range(60)]
    from lamina.llm.shingles import shingle_set

    held = [shingle_set(s) for s in sets]
    import numpy as np

    everyone = np.arange(len(held))
    compare = ngram_join._Compare(0.1, 1e-7)

    def links():
        return {(a, b) for a, hit in compare.pairs(held, everyone, everyone) for b in hit.tolist()}

    plain = links()
    monkeypatch.setattr(ngram_join._Dense, "SLAB", 7)
    monkeypatch.setattr(ngram_join._Dense, "LEAST_FILLED", 0.0)
    assert links() == plain and plain


def test_rows_of_one_column_type(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS).withColumn("n_chars", F.col("n_chars").cast("int"))
    assert merkle_manifest.manifest(docs).first().leaf == h("1:11:s2:en1:33:a b")
