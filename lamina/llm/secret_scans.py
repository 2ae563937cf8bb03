"""Secret scans through a trigram inverted index (DataFrame functions only).

An index holds, for every trigram of every text, a posting (trigram, doc_id): lower-cased trigrams of letters, digits,
underscores and hyphens. From each rule's regex a Boolean query over mandatory trigrams is derived, the postings are
intersected to the documents that satisfy it, and only those are verified with the regex. A rule without mandatory
trigrams is run over every text. An index that is kept (`index`) serves any rules that come later: they read the postings
of their own trigrams and no text but their candidates'.

Scale: the index is made without a shuffle, each task sorting the postings of its own texts by trigram, so each file is a
small inverted index and a lookup skips all row groups but its trigram's. Of the postings that rules ask for one row a
document goes through a shuffle. The resulting masks are sent to the tasks while they are at most `most_sent` rows, so
texts don't move; beyond that texts and masks meet in a join (AQE splits a hot key of it).

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned each by itself;
rows that share a doc_id (or have none) share their candidate mask, which can only add candidates;
spans are in code points, end exclusive; very long texts are indexed and scanned whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: for Java's and Python's regex engines alike. A match shorter than `least` characters, or whose
    group `group` is shorter than `group_least`, is dropped."""

    pattern: str
    least: int = 1
    group: int = 0
    group_least: int = 0


#: Kind -> rule, in the order in which spans of equal start are listed. The first three are the base.
RULES = {
    "assign": Rule(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        group_least=8,
    ),
    "access": Rule(r"AKIA[A-Z0-9]+", least=16),
    "hex": Rule(r"[0-9a-f]{32,}"),
    "github": Rule(r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    "slack": Rule(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": Rule(r"AIza[A-Za-z0-9_-]{35}"),
    "stripe": Rule(r"sk_live_[A-Za-z0-9]{16,}"),
    "jwt": Rule(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "private_key": Rule(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
}
BASE = ("assign", "access", "hex")
MASKED = "[secret]"

#: A query: None (any text), a trigram, or ("and" | "or", parts).
Query = None | str | tuple
MOST_STRINGS = 32
MASK_BITS = 63
#: The trigrams that an index holds.
INDEXED = "[a-z0-9_-]{3}"
MOST_SENT = 500_000


def _grams_of(query: Query) -> frozenset | None:
    """The trigrams of a query that is one trigram or an AND of trigrams."""
    if isinstance(query, str):
        return frozenset([query])
    return frozenset(query[1]) if query[0] == "and" and all(isinstance(p, str) for p in query[1]) else None


def _and(*parts: Query) -> Query:
    held = [p for p in parts if p is not None]
    flat = dict.fromkeys(x for p in held for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,)))
    return None if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def _or(*parts: Query) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    flat = list(dict.fromkeys(parts))
    sets = [_grams_of(p) for p in flat]
    # a part that asks for all that another asks for, and more, adds nothing
    flat = [p for p, own in zip(flat, sets, strict=True) if own is None or not any(x is not None and x < own for x in sets)]
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _grams(strings: set[str]) -> Query:
    """That one of these strings occurs."""
    indexed = re.compile(INDEXED)
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2) if indexed.fullmatch(s, i, i + 3))) for s in sorted(strings)))


def _strings(items) -> set[str] | None:
    """All strings that a part of a pattern can match, lower-cased, if they are few; else None."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            new = {chr(arg).lower()}
        elif op is sre.IN:
            if any(o not in (sre.LITERAL, sre.RANGE) for o, _ in arg):
                return None
            codes = [c for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))]
            new = {chr(c).lower() for c in codes} if len(codes) <= MOST_STRINGS else None
        elif op is sre.SUBPATTERN:
            new = _strings(arg[3])
        elif op is sre.BRANCH:
            each = [_strings(x) for x in arg[1]]
            new = None if None in each else set().union(*each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            once = _strings(arg[2])
            new = once if once is None or arg[0] else once | {""}
        else:
            return None
        if new is None or len(found) * len(new) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in new}
    return found


def _query(items) -> Query:
    parts: list[Query] = []
    run = {""}  # what the strings read so far may end with, as one stretch
    for item in items:
        op, arg = item
        own = _strings([item])
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        parts.append(_grams(run))
        run = {""}
        if own is not None:
            run = own
        elif op is sre.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is sre.BRANCH:
            parts.append(_or(*(_query(x) for x in arg[1])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(arg[2]))
    return _and(*parts, _grams(run))


def trigram_query(pattern: str) -> Query:
    """The trigrams of the lower-cased text without which the pattern can't match."""
    return _query(sre_parser.parse(pattern))


def query_grams(query: Query) -> list[str]:
    if query is None:
        return []
    return [query] if isinstance(query, str) else sorted({g for p in query[1] for g in query_grams(p)})


def _holds(query: Query, bit: dict[str, int]) -> Column:
    if isinstance(query, str):
        return F.col(f"held_{bit[query] // MASK_BITS}").bitwiseAND(F.lit(1 << bit[query] % MASK_BITS)) != 0
    parts = [_holds(p, bit) for p in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index of all texts: gram, doc_id, a row for each document that has the trigram, in order of trigrams
    within each partition. Keep it as Parquet to use it for more rules."""
    found = F.regexp_extract_all(F.lower(text_or_empty()), F.lit(f"(?=({INDEXED}))"), F.lit(1))
    each = pick(docs, "doc_id", "text").select(F.explode(F.array_distinct(found)).alias("gram"), "doc_id")
    return each.sortWithinPartitions("gram")


def candidates(index: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Documents whose postings satisfy a rule's query: doc_id and `may`, whose bit k is set for the k-th rule."""
    queries = {kind: trigram_query(r.pattern) for kind, r in rules.items()}
    grams = sorted({g for q in queries.values() for g in query_grams(q)})
    bit = {g: k for k, g in enumerate(grams)}
    n_masks = 1 + len(grams) // MASK_BITS
    own = [
        F.bit_or(F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << k % MASK_BITS)) for g, k in bit.items() if k // MASK_BITS == m], F.lit(0)).cast("long")).alias(f"held_{m}")
        for m in range(n_masks)
    ]
    held = index.filter(F.col("gram").isin(grams)).groupBy("doc_id").agg(*own)
    may = F.lit(0).cast("long")
    for k, q in enumerate(queries.values()):
        if q is not None:
            may = may.bitwiseOR(F.when(_holds(q, bit), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return held.select("doc_id", may.alias("may")).filter("may <> 0")


def _found(text: Column, kind: str, order: int, rule: Rule) -> Column:
    """Spans (start, order, end, kind) of a rule's matches, left to right."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    span = "struct<start:int,order:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{span}>)").alias("out"))

    def step(state, x):
        s = state["at"] + F.length(x["gap"])
        e = s + F.length(x["match"])
        keep = (e - s >= rule.least) & (F.length(x["group"]) >= rule.group_least)
        one = F.array(F.struct(s.alias("start"), F.lit(order).alias("order"), e.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(e.alias("at"), F.when(keep, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"), groups.alias("group"))
    none = F.expr(f"cast(array() as array<{span}>)")
    return F.when(F.regexp_like(text, pattern), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(none)


def scan(docs: DataFrame, rules: dict[str, Rule] = RULES, index: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """docs (without a column `may` or `_id`) with `found` added: an array of (start, order, end, kind), by start, then by the rules'
    order. index: the postings of docs, if they are kept."""
    queries = {kind: trigram_query(r.pattern) for kind, r in rules.items()}
    masks = cut(candidates(cut(postings(docs)) if index is None else index, rules).select(F.col("doc_id").alias("_id"), "may"))
    if masks.count() <= most_sent:
        masks = F.broadcast(masks)
    joined = docs.join(masks, docs["doc_id"].eqNullSafe(masks["_id"]), "left").drop("_id")
    text = text_or_empty()
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    each = []
    for k, (kind, rule) in enumerate(rules.items()):
        spans = _found(text, kind, k, rule)
        if queries[kind] is not None:
            spans = F.when(F.col("may").bitwiseAND(F.lit(1 << k)) != 0, spans).otherwise(none)
        each.append(spans)
    return joined.withColumn("found", F.array_sort(F.concat(*each))).drop("may")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, rules: dict[str, Rule] = RULES, index: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(pick(docs, "doc_id", "text"), rules, index, most_sent)
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["order"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, rules: dict[str, Rule] = RULES, masked: str = MASKED, most_sent: int = MOST_SENT) -> DataFrame:
    """docs with every stretch that spans cover replaced by `masked`; rows without spans stay as they are."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    found = scan(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("rest")), rules, None, most_sent)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(masked))).otherwise(state["out"]).alias("out"),
        )

    new = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.size("found") > 0, new).otherwise(F.col("text"))
    own = {"text": text.alias("text"), "doc_id": F.col("doc_id")}
    return found.select(*[own.get(c, F.col(f"rest.`{c}`")) for c in docs.columns])


def _oracle() -> str:
    def rows(kind: str, order: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""
  select rid, {order} as k, '{kind}' as kind, start, start + length(m) as stop from (
    select rid, m, g, cast(sum(length(gap)) over q + coalesce(sum(length(m)) over p, 0) as bigint) as start
    from (select rid, unnest(ms) as m, unnest(gs) as g, unnest(gaps[1:len(ms)]) as gap, generate_subscripts(ms, 1) as i
      from (select rid, regexp_extract_all(text, '{p}') as ms, regexp_extract_all(text, '{p}', {rule.group}) as gs,
        string_split_regex(text, '{p}') as gaps from d where regexp_matches(text, '{p}')))
    window q as (partition by rid order by i), p as (partition by rid order by i rows between unbounded preceding and 1 preceding)
  ) where length(m) >= {rule.least} and length(g) >= {rule.group_least}"""

    parts = "\n  union all".join(rows(kind, k, r) for k, (kind, r) in enumerate(RULES.items()))
    counts = ", ".join(f"cast(coalesce(n_{kind}, 0) as bigint) as n_{kind}" for kind in BASE)
    sums = ", ".join(f"sum(cast(k = {k} as int)) as n_{kind}" for k, kind in enumerate(BASE))
    return f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), s as ({parts}
), a as (
  select rid, {sums},
    string_agg(case when k < {len(BASE)} then kind || ':' || start || ':' || stop end, ',' order by start, k) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans
  from s group by rid
)
select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (rid)
"""


ORACLE_SQL = _oracle()
