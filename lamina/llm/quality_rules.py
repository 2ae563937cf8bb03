"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps, per document, the measurements and one long whose bit
k is set when rule k fails. A policy is a named, versioned set of rules; applying one is a bitwise AND
over the ledger and never reads a text again, and the ablation of a policy (what each of its rules
alone rejects) is one aggregation over the few distinct bit patterns.

Scale: measuring is one narrow pass over the texts, a document at a time; the ledger holds no text.
The only shuffle is the ablation's, of one pre-aggregated row per task and bit pattern.

Defined cases: a null text is measured as an empty one, an empty text has no words and fails the rule
on few words alone; repeated rows are measured each by itself; very long texts are measured whole; an empty table gives
an empty ledger and no ablation rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, pieces

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stutters",
    "n_upper",
    "n_lower",
)

#: Rule name -> what makes a document fail it, over the measurements. A rule's bit is its place here:
#: append new rules, never reorder, so that stored ledgers stay readable.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines",
    "stutter": "100 * n_stutters > 30 * n_words",
    "shouting": "n_upper + n_lower >= 20 and 2 * n_upper > n_upper + n_lower",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Policy version -> the rules it enforces.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more in the text, the first included.

    Window hashes find the suspects; the words themselves decide.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    suspects = np.flatnonzero(np.isin(rolled, twice))
    windows = [tuple(words[i : i + width]) for i in suspects.tolist()]
    count = Counter(windows)
    starts = np.array([i for i, w in zip(suspects.tolist(), windows, strict=True) if count[w] > 1], np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one text (UTF-8)."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(bytes.__eq__, words[1:], words)),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, LOWER)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = [measure(x or b"") for x in batch.column(1).to_pylist()]
        columns = zip(*found, strict=True) if found else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(list(x), pa.int64()) for x in columns)], ["doc_id", *MEASURES]
        )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every document."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    measured = texts.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"case when {rule} then {BIT[name]}L else 0L end" for name, rule in RULES.items())
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept`: whether no rule of the policy fails."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: n_fail (documents failing it), n_alone (documents that only it rejects,
    so the policy without the rule keeps them) and n_kept of the whole policy."""
    patterns = entries.groupBy((F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )


def report(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per document: doc_id, the measurements, fail_bits, base_failed and kept."""
    judged = apply_policy(ledger(docs), policy).withColumn(
        "base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    )
    return judged.withColumn("kept", F.col("kept") & ~F.col("base_failed"))


LEDGER_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), win as (
  select rid, i, list_slice(ws, i, i + 7) as w
  from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from d where len(ws) >= 8)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, w) as n from win) where n > 1
), covered as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from twice) group by rid
), m as (
  select d.doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda x: x[1] = x[2])) as n_stutters,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) as n_lower
  from d left join covered c using (rid)
), b as (
  select *, cast(n_words < 20 as bigint) + 2 * cast(100 * n_repeat_words > 30 * n_words as bigint)
    + 4 * cast(10 * n_symbols > n_words as bigint)
    + 8 * cast(n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines as bigint)
    + 16 * cast(100 * n_stutters > 30 * n_words as bigint)
    + 32 * cast(n_upper + n_lower >= 20 and 2 * n_upper > n_upper + n_lower as bigint)
    + 64 * cast(word_chars < 2 * n_words or word_chars > 20 * n_words as bigint) as fail_bits
  from m
)
"""

ORACLE_SQL = (
    LEDGER_SQL
    + """select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_lines as bigint) as n_lines,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  cast(n_stutters as bigint) as n_stutters, cast(n_upper as bigint) as n_upper, cast(n_lower as bigint) as n_lower,
  cast(fail_bits as bigint) as fail_bits, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept
from b
"""
)


def ablation_report(docs: DataFrame) -> DataFrame:
    """policy, rule, n_fail, n_alone, n_kept of every rule of every policy, from one stored ledger."""
    stored = cut(ledger(docs).select("doc_id", "fail_bits"))
    out = None
    for policy in POLICIES:
        one = ablation(stored, policy).select(F.lit(policy).alias("policy"), "rule", "n_fail", "n_alone", "n_kept")
        out = one if out is None else out.unionByName(one)
    return out


_RULE_ROWS = ", ".join(f"('{policy}', '{rule}', {BIT[rule]}, {mask(policy)})" for policy, rules in POLICIES.items() for rule in rules)

ABLATION_SQL = (
    LEDGER_SQL
    + f""", r(policy, rule, bit, mask) as (values {_RULE_ROWS})
select policy, rule, count(*) filter (fail_bits & bit <> 0) as n_fail, count(*) filter (fail_bits & mask = bit) as n_alone, count(*) filter (fail_bits & mask = 0) as n_kept
from b, r group by policy, rule
"""
)
