"""Operator 10, HTML extraction: nearest-URL page differencing.

1. A tag scanner cuts each page into text blocks (lines): block elements end
   a line, white space is one space, character references are decoded.  Every
   line carries the region it stands in: ``article`` (an article or main
   element), ``frame`` (menus, headers, footers, sidebars, notices, adverts,
   forms, reader comments, told by element, role or class words) or ``open``.
2. Pages are paired by URL path within each host: all pages are sorted over
   the cluster by (host, path, id).  Pages of one host and exactly the same
   lines that lie side by side are a run; its partner is the neighbour of the
   same host that shares the longer beginning of the path (the earlier one on
   a tie), and holds for every page of the run.  Only line hashes travel.  The
   pages before and after the first and last run of every sorted part, however
   many parts that run goes over, are its boundary records.  So the pairing
   doesn't depend on the partitioning, and a large host is spread over parts.
3. The two pages' lines are aligned by longest common subsequence
   (bit-parallel), and shared ``open`` lines are deleted.

Lines of an article element are kept even if shared, since near pages may
carry the same passage or article; a page that has such an element consists
of its lines alone.  ``frame`` lines are never text: differencing cannot know
an advert that only one page shows.

Defined cases: null html is an empty page; a null url is the empty host and
path; null ids sort first; rows of equal id and html give equal results;
unclosed elements end with their parents; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import ship_package, spread, stored, text_or_empty
from gramloom.session import maybe_broadcast

ARTICLE, FRAME, OPEN = 2, 1, 0

# Elements and words that mark what is not main text.
DROP = frozenset("script style noscript template head title textarea svg math iframe object canvas audio video select".split())
FRAMES = frozenset("nav footer aside form button menu dialog header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer comment comments reply replies respond disqus cookie cookies "
    "consent notice notices popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended recommendations widget toolbar pagination pager search").split())
OUTER_WORDS = frozenset("header masthead topbar".split())
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - frozenset("body html".split())
# Elements that end an open one of the same group, up to the named parents.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
PARTS = re.compile(r"[A-Za-z]+")


def _marked(tag: str, attrs: str, inside: bool) -> bool:
    """Attributes say that the element is not main text."""
    if tag in ("html", "body", "main"):
        return False
    for k, v in ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id"):
            for name in v.split():
                words = set(PARTS.findall(name))
                if words & WORDS or (not inside and words & OUTER_WORDS):
                    return True
        elif k == "role" and v in ROLES or k == "hidden" or k == "aria-hidden" and v == "true":
            return True
        elif k == "style" and "display:none" in v.replace(" ", ""):
            return True
    return False


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """Text lines of a page and the region of each."""
    lines: list[str] = []
    regions: list[int] = []
    stack: list[tuple[str, int]] = []  # open elements and their regions
    depths: dict[str, list[int]] = {}  # depths of the open elements of each name, ascending
    text: list[str] = []
    region, at = OPEN, 0

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                regions.append(region)

    def pop_to(depth: int) -> None:
        for t, _ in stack[depth:]:
            depths[t].pop()
        del stack[depth:]

    def close_to(depth: int) -> None:
        nonlocal region
        flush()
        pop_to(depth)
        region = stack[-1][1] if stack else OPEN

    def innermost(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> int:
        """Depth of the outermost of ``tags`` above the last stop, or -1."""
        stop = max((depths[t][-1] for t in stops if depths.get(t)), default=-1)
        found = -1
        for t in tags:
            if at_of := depths.get(t):
                k = bisect.bisect(at_of, stop)
                if k < len(at_of) and (found < 0 or at_of[k] < found):
                    found = at_of[k]
        return found

    while m := TAG.search(page, at):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            depth = depths[tag][-1] if depths.get(tag) else -1
            if depth >= 0:
                if tag in BLOCKS or any(t in BLOCKS or r != region for t, r in stack[depth:]):
                    close_to(depth)
                else:
                    pop_to(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in DROP:
            if tag == "head":  # ends with its end tag or with the body
                end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, at)
            else:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not attrs.rstrip().endswith("/"):
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag in ENDS_P and (depth := innermost({"p"}, {"table", "td", "th", "li", "div", "article", "section"})) >= 0:
            close_to(depth)
        if tag in SIBLINGS and (depth := innermost(*SIBLINGS[tag])) >= 0:
            close_to(depth)
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            continue
        inside = region == ARTICLE
        mine = region
        if region != FRAME:
            if (tag in FRAMES and not (tag == "header" and inside)) or _marked(tag, attrs, inside):
                mine = FRAME
            elif tag in ("article", "main"):
                mine = ARTICLE
        if mine != region:
            flush()
        if tag not in BLOCKS and attrs.endswith("/"):
            continue
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, mine))
        region = mine
    text.append(page[at:])
    flush()
    return lines, regions


def main_lines(lines: list[str], regions: list[int], deleted: set[int]) -> list[str]:
    """The article's lines, or without one the open lines that the page
    doesn't share."""
    if ARTICLE in regions:
        return [x for x, r in zip(lines, regions) if r == ARTICLE]
    return [x for k, (x, r) in enumerate(zip(lines, regions)) if r == OPEN and k not in deleted]


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` on a longest common subsequence of both.  Of the bit
    rows about the square root of their number is kept; the way back rebuilds
    the others a stretch at a time."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    # A line that the other side lacks is on no common subsequence.
    either = set(a[lo:len(a) - hi]) & set(b[lo:len(b) - hi])
    at = [k for k in range(lo, len(a) - hi) if a[k] in either]
    y = [v for v in b[lo:len(b) - hi] if v in either]
    out = list(range(lo)) + list(range(len(a) - hi, len(a)))
    if at:
        places: dict[int, list[int]] = {}
        for k, i in enumerate(at):
            places.setdefault(a[i], []).append(k)
        where = {v: _bits(ks) for v, ks in places.items()}
        full = (1 << len(at)) - 1

        def after(s: int, lines: list[int]) -> Iterator[int]:
            for v in lines:  # zero bits of the row count the common subsequence so far
                u = s & where[v]
                s = ((s + u) | (s - u)) & full
                yield s

        step = math.isqrt(len(y)) + 1
        marks, s = [full], full
        for n, s in enumerate(after(full, y), 1):
            if n % step == 0:
                marks.append(s)
        j = len(at)
        for k in range(len(marks) - 1, -1, -1):
            if not j:
                break
            rows = [marks[k], *after(marks[k], y[k * step:(k + 1) * step])]  # rows[n]: after k * step + n lines
            i = len(rows) - 1
            while j and i:
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                elif rows[i - 1] >> (j - 1) & 1:  # this line of the other side brought it
                    i, j = i - 1, j - 1
                    out.append(at[j])
                else:
                    i -= 1
    return sorted(out)


def _bits(places: list[int]) -> int:
    """The number with these (ascending) bits set."""
    raw = bytearray(places[-1] // 8 + 1)
    for k in places:
        raw[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(raw, "little")


def host_and_path(url: str) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url)
    return (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", re.split(r"[?#]", url)[0])


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    for b in batches:
        rows = []
        for pid, h, url, page in zip(*(b.column(k).to_pylist() for k in range(4))):
            lines, regions = lines_of(page)
            host, path = host_and_path(url)
            hashes = np.array([xxhash.xxh64_intdigest(x.encode()) for x in lines], np.uint64).view(np.int64)
            rows.append((pid, h, host, path, hashes, [k for k, r in enumerate(regions) if r == OPEN],
                         ARTICLE not in regions,
                         hashlib.blake2b(host.encode() + b"\0" + hashes.tobytes(), digest_size=16).hexdigest()))
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(),
                 pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["page_id", "h", "host", "path", "hashes", "open", "bare", "key"])


OUTLINE = "page_id long, h long, host string, path string, hashes array<long>, open array<int>, bare boolean, key string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds (part, at, run, head, tail) to the sorted rows of a task: the run
    of equal keys that a row is in, and if it begins or ends it there."""
    part, at, run, held, key = TaskContext.get().partitionId(), 0, -1, None, None

    def out(b: pa.RecordBatch, after: str | None) -> pa.RecordBatch:
        nonlocal at, run, key
        n, keys = b.num_rows, b.column("key").to_pylist()
        head = np.array([x != y for x, y in zip(keys, [key, *keys])], bool)
        tail = np.array([x != y for x, y in zip(keys, [*keys[1:], after])], bool)
        runs = run + np.cumsum(head)
        pos = np.arange(at, at + n)
        at, run, key = at + n, int(runs[-1]), keys[-1]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(pos), pa.array(runs),
                                           pa.array(head), pa.array(tail)],
                                          names=[*b.schema.names, "part", "at", "run", "head", "tail"])
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield out(held, b.column("key")[0].as_py())
            held = b
    if held is not None:
        yield out(held, None)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, at), boundary rows included: deleted lines of
    each page of its own part."""
    def solve(after, last_path):
        near = [(_common(x["path"], path), x) for x, path in ((before, first_path), (after, last_path))
                if x is not None and x["host"] == me["host"]]
        if not near:
            return
        same = set(shared(me["hashes"], max(near, key=lambda x: x[0])[1]["hashes"]))
        for lines, ids in copies.items():
            if cut := sorted(same.intersection(lines)):
                for lo in range(0, len(ids), 1000):
                    yield _cuts([(*x, cut) for x in ids[lo:lo + 1000]])

    part = before = me = first_path = None  # me: the last page of the run
    copies: dict[tuple, list] = {}  # pages of the run by open lines
    for b in batches:
        for row in b.to_pylist():
            if me is not None and (row["part"] != part or not row["own"] or row["key"] != me["key"]):
                after = row if row["part"] == part else None
                yield from solve(after, me["path"] if row["own"] else row["edge"])
                before, me, first_path, copies = me, None, None, {}
            if row["part"] != part:
                part, before, first_path = row["part"], None, None
            if not row["own"]:
                before, first_path = row, row["edge"]
                continue
            if me is None and first_path is None:
                first_path = row["path"]
            me = row
            copies.setdefault(tuple(row["open"]), []).append((row["page_id"], row["h"]))
    if me is not None:
        yield from solve(None, me["path"])


def _cuts(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
         pa.array([x[2] for x in found], pa.list_(pa.int32()))], names=["page_id", "h", "cuts"])


def differences(outlines: DataFrame) -> DataFrame:
    """``(page_id, h, cuts)``: the open lines that each page shares with its
    partner."""
    order = [F.col("host"), F.col("path"), F.col("page_id").asc_nulls_first(), F.col("h")]
    placed = stored(outlines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _placed, OUTLINE + ", part int, at long, run long, head boolean, tail boolean"), "placed")
    runs = F.broadcast(placed.groupBy("part").agg((F.max("run") + 1).alias("runs")))  # one row per part
    ends = (placed.filter("head or tail").join(runs, "part").filter("run < 2 or run >= runs - 2")
            .select("part", "run", "runs", "at", "path", "key", "head", "tail").collect())  # at most eight rows per part
    beside = placed.sparkSession.createDataFrame(_beside(ends), "part int, at long, to int, place long, edge string")
    cols = [c for c in placed.columns if c not in ("part", "at")]
    rows = (placed.select("part", "at", *cols, F.lit(None).cast("string").alias("edge"), F.lit(True).alias("own"))
            .unionByName(placed.join(F.broadcast(beside), ["part", "at"]).select(
                F.col("to").alias("part"), F.col("place").alias("at"), *cols, "edge", F.lit(False).alias("own"))))
    return (rows.repartition("part").sortWithinPartitions("part", "at")
            .mapInArrow(_differ, "page_id long, h long, cuts array<int>"))


def _beside(ends: list) -> list[tuple]:
    """From the ends of the outer runs of every part, the boundary rows
    ``(part, at, part it goes to, place there, edge)``: the pages before and
    after its outer runs, and the path at that end of the whole run."""
    runs: dict[int, int] = {}
    head, tail = {}, {}
    for r in ends:
        runs[r["part"]] = r["runs"]
        if r["head"]:
            head[r["part"], r["run"]] = r
        if r["tail"]:
            tail[r["part"], r["run"]] = r
    parts, out = sorted(runs), []
    for i, p in enumerate(parts):
        me = head[p, 0]
        edge = me["path"]
        for q in reversed(parts[:i]):
            last = runs[q] - 1
            x = tail[q, last]
            if x["key"] == me["key"]:  # the run goes on there
                edge, x = head[q, last]["path"], tail.get((q, last - 1))
            if x is not None:
                out.append((q, x["at"], p, -1, edge))
                break
        me = tail[p, runs[p] - 1]
        edge = me["path"]
        for q in parts[i + 1:]:
            x = head[q, 0]
            if x["key"] == me["key"]:
                edge, x = tail[q, 0]["path"], head.get((q, 1))
            if x is not None:
                out.append((q, x["at"], p, 1 << 62, edge))
                break
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = ["\n".join(main_lines(*lines_of(page), set(cuts or ())))
                 for page, cuts in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)``: the main text of every page."""
    ship_package(pages.sparkSession)
    page = text_or_empty(html_col)
    rows = spread(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.xxhash64(page).alias("h"),
                               F.col(f"`{url_col}`").alias("url"), page.alias("html")))
    outlines = stored(rows.select("page_id", "h", F.coalesce("url", F.lit("")).alias("url"), "html")
                      .mapInArrow(_outline, OUTLINE), "outlines")
    cuts = differences(outlines)
    # Only pages without an article element need their cuts.
    bare = outlines.filter("bare").select(F.col("page_id").alias("b_id"), F.col("h").alias("b_h")).distinct()
    cuts = stored(cuts.join(bare, F.col("page_id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")), "left_semi")
                  .groupBy(F.col("page_id").alias("c_id"), F.col("h").alias("c_h"))
                  .agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts")), "cuts")
    cut = (rows.join(maybe_broadcast(cuts, cuts.count()),
                     F.col("page_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left"))
    return cut.select("page_id", "url", "html", "cuts").mapInArrow(_texts, "page_id long, url string, text string")
