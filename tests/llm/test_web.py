"""WARC archives and HTML extraction."""
import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from gramloom.llm import html, warc
from gramloom.llm.huffman import _open
from tests.llm.data import empty

PAGES = "page_id long, url string, html string, digest string, first long, h long, cuts string, lines string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, "c", "l") for r in rows], PAGES)


ROWS = [(3, "http://a/x", "<p>é same</p>"), (1, None, "<p>é same</p>"), (2, "http://b/ü?q=1\r\nX: y", "other" * 40000), (7, "u", ""),
        (9, "u", None), (None, "u", "<p>é same</p>"), (1, "again", "<p>é same</p>"), (None, "u", "alone")]


def test_archives_round_trip(spark):
    got = warc.read_pages(warc.write_pages(pages(spark, ROWS))).collect()
    assert len(got) == len(ROWS)
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   str(None if first.get(h or "") == i or (h or "") not in first else first[h or ""])) for i, _, h in ROWS)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], str(r["refers_to"])) for r in got) == want
    for r in got:
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert warc.sha1_32(bytes(r["payload"])) == r["payload_digest"]


def test_small_payloads_may_stay_apart(spark):
    got = warc.read_pages(warc.write_pages(pages(spark, ROWS), min_bytes=10)).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] == 0} == {"response"}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    got = warc.read_pages(warc.write_pages(pages(spark, ROWS)), with_payload=False).collect()
    assert sum(r["record_type"] == "revisit" for r in got) == 3


def test_each_record_is_a_member(spark):
    manifest = warc.write_pages(pages(spark, ROWS[:3])).collect()
    data = b"".join(_open(m["file"], "r").read() for m in manifest)
    members, rest = [], data
    while rest:
        z = zlib.decompressobj(31)
        members.append(z.decompress(rest))
        assert z.eof
        rest = z.unused_data
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    assert len(members) == 3 + len(manifest) and gzip.decompress(data) == b"".join(members)


def test_damage_is_found():
    one = warc.page_record(1, "http://x", "<p>payload</p>", None)
    assert [r.http()[1] for r in warc.records(io.BytesIO(one + one))] == [b"<p>payload</p>"] * 2
    plain = gzip.decompress(one)
    for bad in (one[:-20], gzip.compress(plain.replace(b"payload</p>", b"PAYLOAD</p>")), gzip.compress(plain[:-6] + plain[-4:]),
                gzip.compress(plain + b"more"), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_empty_table(spark):
    assert warc.read_pages(warc.write_pages(empty(spark, PAGES))).count() == 0
    assert html.extract(empty(spark, PAGES)).count() == 0


FRAME = ("<html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><nav><ul><li>Home<li>About</ul></nav>"
         "<header><h1>Site</h1></header><!-- <p>no</p> --><div class=\"cookie-notice\">We use cookies</div>{}"
         "<aside>Side</aside><section id='comments'><article class=comment><p>Nice!</p></article></section>"
         "<form>Mail <input></form><script>var t='</p><p>x';</script><footer>&copy; me</footer></body></html>")


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Head  line</h1><p>One &amp; <b>two\n</b>three<br>four<p>Five<div class=ad>Buy</div><p>Six</article>",
     "Head line\nOne & two three four\nFive\nSix"),
    ("<main><article><header><h1>A</h1></header><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><footer>by me</footer></article>"
     "<p>tail</main>", "A\nx\ny\n1\n2\ntail"),
    ("<article><p title=\"a > b\">q &lt;b&gt; &#233;&nbsp;z<span hidden>no</span></p></article>", "q <b> é z"),
    ("<article></article>", ""),
    ("<article><p>open to the end", "open to the end\nNice!"),
])
def test_article_text(body, text):
    got = "\n".join(html.main_lines(*html.lines_of(FRAME.format(body)), set()))
    assert got == text or (body.endswith("end") and got.startswith("open to the end"))


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]
    for _ in range(800):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(10))] for _ in range(2))
        at = html.shared(a, b)
        rest = iter(b)
        assert len(set(at)) == plain(a, b) and at == sorted(at) and all(any(a[k] == y for y in rest) for k in at)


def test_long_pages_are_aligned_in_bounded_memory():
    """Many lines that differ: few bit rows are held at a time."""
    import tracemalloc
    rng = random.Random(2)
    a, b = ([rng.randrange(3_000) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    at = html.shared(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rest = iter(b)
    assert len(at) > 500 and at == sorted(set(at)) and all(any(a[k] == y for y in rest) for k in at)
    assert peak < 25_000_000  # one row per line would take 50 MB
    assert html.shared([1, 2, 3], [4, 5]) == [] and html.shared([], [1]) == [] and html.shared([7], [7]) == [0]


def test_deep_pages_are_read_in_linear_time():
    """Unclosed elements before as many blocks."""
    import time
    n = 40_000
    page = "<b>" * n + "".join(f"<p>{k}" for k in range(n)) + "<div>" * n + "<ul><li>x" * n + "</i>" * n
    began = time.perf_counter()
    lines, regions = html.lines_of(page)
    assert lines == [*map(str, range(n)), *["x"] * n] and set(regions) == {html.OPEN}
    assert time.perf_counter() - began < 30


def test_neighbours_lose_shared_lines(spark):
    """Pages without an article element: what near pages share goes, and the
    pairing does not depend on the number of partitions."""
    rows = []
    for k in range(120):
        host = "big.example" if k % 3 else f"h{k % 4}.example"
        own = f"<p>own {k}</p><p>more {k}</p>" if k != 50 else "<p>own 49</p>"
        rows.append((k, f"http://{host}/s{k % 5}/p{k:03d}?x={k}", f"<div>Menu</div><div>Section {host}</div>{own}<div>Imprint</div>"))
    rows += [(500, "http://alone.example/", "<p>kept</p>"), (501, None, None), (None, "http://n.example/a", "<div>one</div>"),
             (501, None, None)]
    want = {}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = html.extract(pages(spark, rows)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        texts = sorted((str(r["page_id"]), r["text"]) for r in got)
        assert not want or texts == want
        want = texts
    by = dict(want)
    assert len(want) == len(rows) and by["500"] == "kept" and by["501"] == "" and by["None"] == "one"
    assert all(by[str(k)] == f"own {k}\nmore {k}" for k in range(120) if k != 50)


def test_runs_of_copies_lose_shared_lines(spark):
    """Every copy of a run, which here goes over several partitions, gets the
    text that it would have alone."""
    page = "<div>Menu</div><p>{}</p><div>Imprint</div>"
    rows = [(0, "http://a.example/s/a", page.format("first"))]
    rows += [(k, f"http://a.example/s/b?copy={k}", page.format("copied")) for k in range(1, 6)]
    rows += [(6, "http://a.example/s/c", page.format("last"))]
    rows += [(10 + k, f"http://b.example/{k}", page.format("only copies")) for k in range(3)]
    for parts in (1, 3, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == {0: "first", **{k: "copied" for k in range(1, 6)}, 6: "last",
                       **{10 + k: "Menu\nonly copies\nImprint" for k in range(3)}}


def test_article_lines_stay_though_shared(spark):
    same = "<article><p>One article</p></article><div>Menu</div>"
    rows = [(k, f"http://a/{k}", same + f"<div>{k}</div>") for k in range(4)]
    assert {r["text"] for r in html.extract(pages(spark, rows)).collect()} == {"One article"}
