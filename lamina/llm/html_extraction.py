"""Main-text extraction by nearest-URL page differencing.

Each page becomes text lines (its blocks), furniture included. Pages are paired with the page of the same host whose
URL path is nearest in path order; the lines of a pair are aligned by their longest common subsequence, and the
shared lines, a site's furniture, are deleted.

Differencing alone can't give right results: a copied article is shared, and an advert of the day or a reader's
comment is not. So the markup corrects it both ways. A shared line inside an article or main element is the article
and comes back; a line that is not shared goes after all where its element is furniture by tag, class, id or role, or
where it stands outside the page's article. Where a page has no such element and no such marks, the differencing alone
decides. A whole class name or id marks furniture (of a heading only its class); inside an article, and of
an article or main element itself, only a whole class name does, and nothing on a heading. Any other word of a class or id outside
an article is a hint, which differencing overrules: what is not shared stays. Only a page without a neighbour follows
its hints, unless they leave nothing. An article under a hint is the page's article where there is no other, else furniture. No
other attribute's value counts. An element of furniture that closes itself (<svg/>) holds nothing.

Scale: parsing is narrow and linear in a page; the lines are shuffled once and read in order of host and path as a
stream that holds three pages. The pages are dealt by ranges of that order, of at most `group_pages` pages each (more where
there would be over `most_groups` ranges). The bounds come from a sort of the keys alone, without the html, and
are sent to all tasks. The page on each side of a bound within a host goes to the range beyond it too, as a
neighbour only, so the size of the ranges doesn't change any text. Lines are aligned in bits, a line of the neighbour
each, and the rows of that table are kept up to CELLS bits, beyond which the pages are halved first.

Defined cases: a null or empty html has an empty text; pages without a host are a group of their own; a
neighbour with the same lines is a copy and deletes nothing, so a page between two copies of itself keeps its lines; of
two equally near pages the earlier in
order counts; repeated rows are pages each and stay in one range; very long pages are read whole; after a tag that never
ends, quotes no longer hide the end of a tag; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import os.path
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces

GROUP_PAGES = 250
MOST_GROUPS = 50_000

#: Pages that a task holds as Python objects at once.
ROWS = 64
FOUND = ("page_id", "url", "text", "n_lines", "n_shared", "n_back", "n_marked")

#: The order of pages.
KEY = ("host", "path", "page_id", "url")

#: Elements whose content is never part of the text.
DROPPED_TAGS = frozenset(
    "head title nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu".split()
)
#: Elements that hold an article.
ARTICLE_TAGS = frozenset("article main".split())
#: Elements read as raw text up to their end tag.
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg".split())
#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that mark furniture.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login paywall toolbar widget copyright disclaimer".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL
)
#: The same without quotes.
BARE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.DOTALL)
START = re.compile(r"<(?=[A-Za-z/!?])")
#: One attribute: its name, and its value in double quotes, in single quotes or bare.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
#: Without one of these no attribute is read.
READ = re.compile("class|id|role", re.IGNORECASE)  # hidden holds id
WORDS = re.compile(r"[a-z]+")

#: Where a line stands: in an article, in furniture by markup, in what a word hints to be furniture, in an article under such
#: a hint, or in none of these.
ARTICLE, MARKED, HINTED, UNDER, OPEN = "a", "m", "h", "u", "o"
CELLS = 1 << 28


def _zone(tag: str, attributes: str, in_article: bool) -> str | None:
    """What an element's start says about what is in it: "drop", "hint", ARTICLE, "title" (only headings count) or None."""
    if tag in DROPPED_TAGS:
        return "drop"
    if tag == "header":
        return "title" if in_article else "drop"
    if READ.search(attributes):
        named: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            named.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        role = named.get("role", "").strip()
        if "hidden" in named or role in DROPPED_ROLES:
            return "drop"
        if role in ("main", "article"):
            return ARTICLE
        marks: list[str] = []
        if in_article or tag in ARTICLE_TAGS:
            marks = [] if tag in HEADINGS else named.get("class", "").split()
        elif tag not in ("html", "body"):
            names = named.get("class", "") + ("" if tag in HEADINGS else " " + named.get("id", ""))
            marks = names.split()
            if DROPPED_WORDS.isdisjoint(marks) and not DROPPED_WORDS.isdisjoint(WORDS.findall(names)):
                return "hint"
        if not DROPPED_WORDS.isdisjoint(marks):
            return "drop"
    return ARTICLE if tag in ARTICLE_TAGS else None


def _tags(html: str) -> Iterator[tuple[int, int, re.Match]]:
    """Start and end of each piece of markup, and its match. Linear: what fails once to end within quotes is looked for
    without them from there on, and where no > is left nothing is markup."""
    pattern, at, last = MARKUP, 0, html.rfind(">")
    while (found := START.search(html, at)) is not None:
        start = found.start()
        if start > last and not html.startswith("<!--", start):
            return
        m = pattern.match(html, start)
        if m is None and pattern is MARKUP and BARE.match(html, start):
            pattern = BARE
            m = BARE.match(html, start)
        if m is None:
            at = start + 1
            continue
        at = m.end()
        resume = yield start, at, m
        if resume is not None:
            at = resume


def _closes_itself(html: str, at: int, tag: str, attributes: str, ends: dict[str, int]) -> bool:
    """Whether a tag that ends in / before place `at` opens nothing. A / that may belong to a bare value counts where no end tag
    follows; `ends` keeps the last one's place by tag."""
    if not attributes.endswith("/"):
        return False
    last = attributes.split()[-1]
    if "=" not in last or last[-2] in "\"'":
        return True
    if tag not in ends:
        ends[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", html, re.IGNORECASE)), default=-1)
    return ends[tag] < at


def lines_of(html: str) -> tuple[list[str], str]:
    """The page's text lines in order, and for each its zone."""
    lines: list[str] = []
    zones: list[str] = []
    held: list[str] = []
    hinted: list[str] = []
    marked: list[str] = []
    ends: dict[str, int] = {}
    stack: list[tuple[str, str | None]] = []
    open_tags: Counter = Counter()
    drop = hint = article = title = heading = 0

    def flush() -> None:
        for parts, zone in ((held, ARTICLE if article else OPEN), (hinted, UNDER if article else HINTED), (marked, MARKED)):
            if parts:
                line = " ".join(html_lib.unescape("".join(parts)).split())
                parts.clear()
                if line:
                    lines.append(line)
                    zones.append(zone)

    def leave() -> str:
        nonlocal drop, hint, article, title
        tag, zone = stack.pop()
        open_tags[tag] -= 1
        drop -= zone == "drop"
        hint -= zone == "hint"
        article -= zone == ARTICLE
        title -= zone == "title"
        return tag

    def place() -> list[str]:
        return marked if drop or (title and not heading) else hinted if hint else held

    def text(start: int, end: int) -> None:
        if end > start:
            place().append(html[start:end])

    at = 0
    tags = _tags(html)
    step = next(tags, None)
    while step is not None:
        start, end, m = step
        text(at, start)
        at = end
        resume = None
        if m[2]:
            tag, closes = m[2].lower(), bool(m[1])
            block = tag in BLOCK_TAGS
            if tag == "br":
                place().append(" ")
            elif block:
                flush()
            if tag in HEADINGS:
                heading = 0 if closes else 1
            if closes:
                if open_tags[tag]:
                    while leave() != tag:
                        pass
            elif tag != "br":
                if block and stack and stack[-1][0] == "p":
                    leave()
                zone = _zone(tag, m[3], article > 0)
                if tag in DROPPED_TAGS and _closes_itself(html, at, tag, m[3], ends):
                    pass
                elif tag in RAW_TAGS:
                    end_tag = re.compile(rf"</{tag}\b", re.IGNORECASE).search(html, at)
                    at = resume = (html.find(">", end_tag.end()) if end_tag else -1) + 1 or len(html)
                # paragraphs and inline elements only count when they are furniture
                elif tag not in VOID_TAGS and (zone is not None or (block and tag not in ("p", "li", "td", "th", "tr", "dt", "dd"))):
                    stack.append((tag, zone))
                    open_tags[tag] += 1
                    drop += zone == "drop"
                    hint += zone == "hint"
                    article += zone == ARTICLE
                    title += zone == "title"
        try:
            step = tags.send(resume)
        except StopIteration:
            break
    text(at, len(html))
    flush()
    return lines, "".join(zones)


def _places(b: list[str]) -> dict[str, int]:
    """For each line of b the places it has, as bits."""
    out: dict[str, int] = {}
    for j, line in enumerate(b):
        out[line] = out.get(line, 0) | 1 << j
    return out


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each beginning of a, none included: bit j is 0 where the common subsequence with b[:j + 1] is longer than that
    with b[:j] (the bits of a row of the usual table, all lines of b at once)."""
    places = _places(b)
    whole = (1 << len(b)) - 1
    row = whole
    yield row
    for line in a:
        both = row & places.get(line, 0)
        row = ((row + both) | (row - both)) & whole
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[str], b: list[str], cells: int = CELLS) -> set[int]:
    """Places in a of a longest common subsequence of lines of a and b: the same start and end, and between them what the
    table says from its last corner back, of equal ways the one that leaves b first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return out
    if len(a) * len(b) > cells and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        out |= {head + i for i in common_lines(a[:half], b[:cut], cells)}
        return out | {head + half + i for i in common_lines(a[half:], b[cut:], cells)}
    rows = list(_rows(a, b))
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if rows[i] >> (j - 1) & 1:
                j -= 1
                out.add(head + i)
    return out


def judge(lines: list[str], zones: str, neighbours: list[list[str]]) -> tuple[str, int, int, int, int]:
    """The kept lines, joined, and how many lines there are, are shared with the nearest page, come back as the article's,
    and go by their markup. neighbours: the lines of the nearest pages, the nearest first."""
    partner = next((n for n in neighbours if n != lines), None)
    shared = common_lines(lines, partner) if partner is not None else set()
    zones = zones.replace(UNDER, MARKED if ARTICLE in zones else ARTICLE)
    follow_hints = partner is None and OPEN in zones
    kept, back, gone = [], 0, 0
    for i, (line, zone) in enumerate(zip(lines, zones, strict=True)):
        if i in shared:
            if zone == ARTICLE:
                back += 1
                kept.append(line)
        elif zone == MARKED or (zone in (OPEN, HINTED) and ARTICLE in zones) or (zone == HINTED and follow_hints):
            gone += 1
        else:
            kept.append(line)
    return "\n\n".join(kept), len(lines), len(shared), back, gone


def _keys(rows: pa.RecordBatch) -> list[tuple]:
    """Each row's place in the order of pages, nulls first as Spark sorts them."""
    columns = (rows.column(c).to_pylist() for c in KEY)
    return [(h, p, i is not None, i or 0, u is not None, u or "") for h, p, i, u in zip(*columns, strict=True)]


def _marks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's ordered keys: every size-th, the one before each of these, and the last."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, last = TaskContext.get().partitionId(), 0, None

        def numbered(rows: pa.RecordBatch, places: list[int]) -> pa.RecordBatch:
            ids = [pa.array([task] * len(places), pa.int64()), pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays([*ids, *(rows.column(c) for c in KEY)], ["task", "place", *KEY])

        for batch in batches:
            if batch.num_rows:
                at = [k for k in range(batch.num_rows) if (n + k) % size in (0, size - 1)]
                yield numbered(batch.take(pa.array(at, pa.int64())), [n + k for k in at])
                n += batch.num_rows
                last = batch.slice(batch.num_rows - 1)
        if last is not None and (n - 1) % size not in (0, size - 1):
            yield numbered(last, [n - 1])

    return marked


def _bounds(keys: DataFrame, size: int) -> tuple[list[tuple], list[tuple]]:
    """The first key of each range but the first, and the key before each of these."""
    marks = keys.orderBy(*KEY).mapInArrow(_marks(size), "task long, place long, host string, path string, page_id long, url string")
    found = marks.toArrow().sort_by([("task", "ascending"), ("place", "ascending")]).combine_chunks()
    bounds, before = [], []
    for batch in found.to_batches():
        held = _keys(batch)
        for place, key, previous in zip(batch.column("place").to_pylist()[1:], held[1:], held, strict=False):
            if place % size == 0 and key != previous:
                bounds.append(key)
                before.append(previous)
    return bounds, before


def _parse(bounds: list[tuple], before: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pages' lines, each in its range, and beside a bound in the range beyond too (beside: true)."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [lines_of(x) if x else ([], "") for x in batch.column("html").to_pylist()]
            dealt = []
            for k, key in enumerate(_keys(batch)):
                part = bisect_right(bounds, key)
                dealt.append((k, part, False))
                if part and key == bounds[part - 1] and key[0] == before[part - 1][0]:
                    dealt.append((k, part - 1, True))
                if part < len(bounds) and key == before[part] and key[0] == bounds[part][0]:
                    dealt.append((k, part + 1, True))
            at = pa.array([x[0] for x in dealt], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in KEY),
                    pa.array([x[1] for x in dealt], pa.int64()),
                    pa.array([x[2] for x in dealt], pa.bool_()),
                    pa.array([found[x[0]][0] for x in dealt], pa.list_(pa.string())),
                    pa.array([found[x[0]][1] for x in dealt], pa.string()),
                ],
                [*KEY, "part", "beside", "lines", "zones"],
            )

    return parsed


def _near(a: dict, b: dict | None) -> int:
    """Length of the shared start of two pages' paths, -1 without a second page of the same host and range."""
    if b is None or (a["host"], a["part"]) != (b["host"], b["part"]):
        return -1
    return len(os.path.commonprefix([a["path"], b["path"]]))


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of part, host and path: each with its main text, but none for those that are only beside."""
    before = page = None

    def judged(before: dict | None, page: dict, after: dict | None) -> tuple:
        near = [(-_near(page, x), k, x) for k, x in enumerate((before, after))]
        neighbours = [x["lines"] for n, _, x in sorted(near, key=lambda y: y[:2]) if n <= 0]
        return page["page_id"], page["url"], *judge(page["lines"], page["zones"], neighbours)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(FOUND)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.string() if name in ("url", "text") else pa.int64()) for c, name in zip(columns, FOUND, strict=True)], list(FOUND)
        )

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = []
            for after in batch.slice(at, ROWS).to_pylist():
                if page is not None and not page["beside"]:
                    rows.append(judged(before, page, after))
                before, page = page, after
            yield out(rows)
    if page is not None and not page["beside"]:
        yield out([judged(before, page, None)])


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES, most_groups: int = MOST_GROUPS) -> DataFrame:
    """page_id, url, text (empty if none) of every page, and of its lines how many there are (n_lines), are shared with the
    nearest page (n_shared), are kept though shared (n_back) and go by their markup though not shared (n_marked)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    located = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"),
        "url",
        "html",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?(.*)$", 1).alias("path"),
    )
    size = max(group_pages, -(-pages.count() // most_groups))
    lines = located.mapInArrow(
        _parse(*_bounds(located.select(*KEY), size)),
        "host string, path string, page_id long, url string, part long, beside boolean, lines array<string>, zones string",
    )
    tie = F.xxhash64("lines", "zones")
    ordered = lines.withColumn("tie", tie).repartition("part").sortWithinPartitions("part", *KEY, "tie").drop("tie")
    return ordered.mapInArrow(_difference, "page_id long, url string, text string, n_lines long, n_shared long, n_back long, n_marked long")


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines and n_shared of every page."""
    found = extract(pages).select("page_id", "url", "text", "n_lines", "n_shared")
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: The lines of each page by regexes that fit the given pages, its nearest page, and the table of the longest common
#: subsequence. Which lines of equally long ones it holds is no matter for the text: the given pages have an article each.
ORACLE_SQL = r"""
with p as (
  select page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) as host,
    regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?((?s).*)$', 1) as path,
    regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>', '', 'g') as body
  from pages
), c as (
  select page_id, url, host, path, unnest([1, 2, 3]) as zone,
    unnest([regexp_extract(body, '(?s)^(.*)<article>', 1), regexp_extract(body, '(?s)<article>(.*)</article>', 1), regexp_extract(body, '(?s)</article>(.*)$', 1)]) as part
  from p
), z as (
  select page_id, url, host, path, zone, list_filter(list_transform(
      string_split_regex(part, '</?(p|h1|h2|h3|div|nav|ul|ol|li|section|blockquote|footer|header|body|html|head)( [^>]*)?>'),
      lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(x, '<br/?>', ' ', 'g'), '<[^>]*>', '', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'))),
    lambda x: x <> '') as lines
  from c
), l as (
  select page_id, url, host, path, flatten(list(lines order by zone)) as lines, max(case when zone = 2 then lines end) as article from z group by all
), n as (
  select *, lag(path) over w as path_1, lag(lines) over w as lines_1, lead(path) over w as path_2, lead(lines) over w as lines_2
  from l window w as (partition by host order by path, page_id nulls first, url nulls first)
), d as (
  select *, coalesce(list_max(list_filter(range(0, length(path) + 1), lambda i: left(path, i) = left(path_1, i) and i <= length(path_1))), -1) as near_1,
    coalesce(list_max(list_filter(range(0, length(path) + 1), lambda i: left(path, i) = left(path_2, i) and i <= length(path_2))), -1) as near_2
  from n
), m as (
  select *, case when near_1 >= near_2 then [lines_1, lines_2] else [lines_2, lines_1] end as others from d
), q as (
  select *, coalesce(list_filter(others, lambda o: o is not null and o <> lines)[1], []) as other from m
)
select page_id, url, array_to_string(article, chr(10) || chr(10)) as text, cast(length(array_to_string(article, chr(10) || chr(10))) as bigint) as n_chars,
  cast(len(lines) as bigint) as n_lines,
  cast(list_last(list_reduce(lines, lambda held, x: list_reduce(range(1, len(other) + 1),
    lambda made, j: list_append(made, case when other[j] = x then held[j] + 1 else greatest(held[j + 1], made[len(made)]) end), [0::bigint]),
    list_transform(range(0, len(other) + 1), lambda k: 0::bigint))) as bigint) as n_shared
from q
"""
