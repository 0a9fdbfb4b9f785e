"""Operators on pages, vectors and conversations, edge cases included."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from shoalsong.llm import chat, embeddings, extract, warc

PAGES = "page_id bigint, url string, html string, first string, refers_to string, host string, text string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a b\r\nc", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "u", None), (8, "u", ""), (None, "n", "<p>é</p>"),
            (2, "z", "<p>é</p>"), (9, "http://x.example/q", "x" * 300_000), (11, "u", "tiny"), (12, "u", "tiny")]
    return spark.createDataFrame([(*r, "f", "r", "h", "t") for r in rows], PAGES)


def test_archives_round_trip(pages):
    index = warc.write_archives(pages)
    found = warc.read_records(index).collect()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert len(found) == 9
    for r in found:
        payload = html[None if r.record_id.endswith("None") else int(r.record_id.split(":")[-1])]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.payload_bytes == len(payload)
        assert (r.payload is None) == (r.record_type == "revisit") and r.payload in (None, payload)
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in found)
    assert kinds == sorted([
        ("urn:pages:2", "response", None), ("urn:pages:2", "response", None), ("urn:pages:5", "revisit", "urn:pages:2"),
        ("urn:pages:None", "revisit", "urn:pages:2"), ("urn:pages:7", "response", None), ("urn:pages:8", "revisit", "urn:pages:7"),
        ("urn:pages:9", "response", None), ("urn:pages:11", "response", None), ("urn:pages:12", "revisit", "urn:pages:11")])


def test_small_payloads_are_not_revisited(pages):
    found = warc.read_records(warc.write_archives(pages, min_bytes=6)).collect()
    assert sum(r.record_type == "revisit" for r in found) == 2  # those of <p>é</p>, 9 bytes


def test_archives_are_plain_warc(spark, pages):
    index = warc.write_archives(pages, archive_bytes=400).collect()
    paths = sorted({r.path for r in index})
    assert len(paths) > 1
    for path in paths:
        with open(path, "rb") as file:
            data = gzip.GzipFile(fileobj=io.BytesIO(file.read())).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    again = warc.index_archives(spark, paths).collect()
    key = lambda r: (r.path, r.offset)
    assert [(r.record_id, r.digest, r.record_type, *key(r), r.length) for r in sorted(again, key=key)] == [
        (r.record_id, r.digest, r.record_type, *key(r), r.length) for r in sorted(index, key=key)]


def test_plain_archives_and_selection(spark, tmp_path):
    records = [warc.record(f"urn:x:{i}", "http://x", b"p" * i, warc.sha1_base32(b"p" * i), None, "2000-01-01T00:00:00Z") for i in range(50)]
    path = tmp_path / "plain.warc"
    path.write_bytes(b"".join(records))
    index = warc.index_archives(spark, [str(path)])
    assert index.count() == 50
    chosen = index.where("record_id in ('urn:x:3', 'urn:x:4', 'urn:x:40')")
    for gap in (0, 1 << 20):
        found = warc.read_records(chosen, gap=gap).collect()
        assert sorted((r.record_id, r.payload_bytes) for r in found) == [("urn:x:3", 3), ("urn:x:4", 4), ("urn:x:40", 40)]
    assert warc.read_records(index.limit(0)).count() == 0


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_records(warc.write_archives(none)).count() == 0
    assert extract.main_texts(none).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad-box">Buy</div><div id="cookie-notice">We use cookies</div><main><article class="post">
<header><h1>T &amp; &eacute;&#x41;</h1></header><p>One<br>two&nbsp;
 three<p>Four <b>bo</b>ld<script>if(a<b)c()</script><aside>side</aside><div class="share-buttons">share</div>
<form><input>send</form><div hidden>gone</div><div style="display: none">gone</div><table><tr><td>c1<td>c2</table>
<section class="comments"><p>a reader</p></section><ul><li>i1<li>i2</ul>5 < 6</article><div class="related">more</div></main>
<footer>foot</footer></body></html>"""


def test_article_without_its_surroundings():
    kept = [text for zone, text, _ in extract.blocks(ARTICLE) if zone == extract.MAIN]
    assert kept == ["T & éA", "One two three", "Four bold", "c1", "c2", "i1", "i2", "5 < 6"]


def test_broken_pages():
    for page in ("", "<", "<p", "<p><b>x", "</p></div>y", "<!--", "<script>x", "<a href='>z", "&#xZZ; &bogus; &amp", "<nav><p>x<article>y"):
        extract.blocks(page)
    assert [b[:2] for b in extract.blocks("<nav><li>x<article>y")] == [(0, "x"), (1, "y")]
    assert [b[1] for b in extract.blocks("<p><b>x<p>y")] == ["x", "y"]


def test_repeated_runs_equal_brute_force():
    rng = np.random.RandomState(0)
    for _ in range(20):
        size = rng.randint(1, 60, 6)
        page = np.repeat(np.arange(6), size)
        tokens = rng.randint(0, 3, len(page)).astype(np.uint64)
        copy = np.array([0, 1, 2, 3, 3, 4])[page]
        places = {}
        for i in range(len(page) - 3):
            if page[i] == page[i + 3]:
                places.setdefault(tuple(tokens[i : i + 4]), []).append(i)
        wanted = np.zeros(len(page), bool)
        for at in places.values():
            if len({copy[i] for i in at}) >= 3:
                for i in at:
                    wanted[i : i + 4] = True
        assert (extract.boilerplate(tokens, page, copy, run=4, pages=3) == wanted).all()


def test_boilerplate_of_pages_without_article(spark):
    menu, legal = "home news sport about us contact login help", "copyright all rights reserved by the site owners since long"
    rows = []
    for i in range(12):
        own = " ".join(f"w{i}x{k}" for k in range(60))
        rows.append((i, f"http://h{i // 6}.example/{i}", f"<div>{menu}</div><div>{own}</div><div>{legal}</div>"))
    rows += [(100 + i, "http://h0.example/copy", "<div>" + " ".join(f"v{k}" for k in range(40)) + "</div>") for i in range(5)]
    rows += [(200, None, None), (201, "no host", "<div>alone here</div>"), (202, "", "")]
    found = {r.page_id: r.text for r in extract.main_texts(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(found) == len(rows)
    assert found[3] == " ".join(f"w3x{k}" for k in range(60))
    assert found[101] == " ".join(f"v{k}" for k in range(40))  # copies are no boilerplate
    assert (found[200], found[201], found[202]) == ("", "alone here", "")


def test_large_hosts_have_several_arrays(spark):
    rows = [(i, "http://x/", f"<nav>n</nav><article><h1>t{i}</h1><p>{'a b ' * 50}</p></article>") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = extract.main_texts(frame, array_chars=2000).collect()
    assert sorted((r.page_id, r.text) for r in found) == [(i, f"t{i}\n{('a b ' * 50).strip()}") for i in range(40)]


def vectors():
    rng = np.random.RandomState(3)
    x = rng.randn(300, 16)
    x[50:90] = x[:40] + 0.05 * rng.randn(40, 16)
    x[90:130] = x[130] + 0.25 * rng.randn(40, 16)  # many partners
    x[200:230] = x[199]  # copies
    x[231] = -x[230]
    x[232] = 1e150 * x[233]
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, [float(k) for k in v]) for i, v in ((1, [3, 4]), (2, [6, 8.0]), (3, [4, 3]), (4, [0, 0]), (5, []))]
    return rows + [(6, None), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (1000, x[0].tolist()), (None, x[1].tolist())]


@pytest.mark.parametrize("block, per_pivot", [(2048, 4096), (16, 20)])
def test_vectors_equal_all_pairs(spark, monkeypatch, block, per_pivot):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PER_PIVOT", per_pivot)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 0, "n", "x") for i, v in rows],
                                  "vec_id bigint, embedding array<double>, id bigint, n string, vector string")
    found = embeddings.near_duplicate_vectors(frame, 0.9).collect()

    def good(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)

    def cosine(a, b):
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))

    n, links = len(rows), [[] for _ in rows]
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            va, vb = rows[a][1], rows[b][1]
            if good(va) and good(vb) and len(va) == len(vb) and cosine(va, vb) >= 0.9:
                links[a].append(b)
                links[b].append(a)
    changed = True
    while changed:
        changed = False
        for a in range(n):
            low = min([label[a], *(label[b] for b in links[a])])
            changed |= low != label[a]
            label[a] = low
    low = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    wanted = [(i, len(k), low.get(g), i == low.get(g)) for (i, _), k, g in zip(rows, links, label)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([tuple(r) for r in found], key=key) == sorted(wanted, key=key)


def test_no_vectors(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_the_inequality_spares_cells(spark):
    """Tight clusters far apart: members are copied to few cells."""
    rng = np.random.RandomState(0)
    centres = np.eye(32)
    rows = [(i, (centres[i % 32] + 0.005 * rng.randn(32)).tolist()) for i in range(640)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    classes = embeddings.usable(frame).selectExpr("vec_id as id", "width", "vector", "1 as n")
    pivots = {32: centres}
    limit = float(np.arccos(0.9))
    placed = embeddings.members(classes, pivots, limit, "<f8", {(32, c): 0.1 for c in range(32)})
    assert placed.count() == 640


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules", 0), (1, 1, "ann", "hi <|end|>", 0), (1, 2, "bob", None, 0), (1, 2, "ann", "x", 0),
            (1, 2, "ann", "x", 0), (1, None, "bob", "first é", 0), (2, 1, "system", "only", 0), (None, 1, None, "who", 0)]
    found = chat.perspectives(spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string, begin bigint")).collect()
    assert {(r.conv_id, r.perspective) for r in found} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    whole = {}
    for r in sorted(found, key=lambda r: (str(r.conv_id), r.perspective, r.position)):
        text = whole.setdefault((r.conv_id, r.perspective), "")
        assert r.begin == len(text) and r.end == len(text) + len(r.rendered)
        whole[r.conv_id, r.perspective] += r.rendered
    assert whole[1, "ann"] == (
        "<|user name=bob|>\nfirst é<|end|>\n<|system|>\nrules<|end|>\n<|assistant|>\nhi < |end|><|end|>\n"
        "<|assistant|>\nx<|end|>\n<|assistant|>\nx<|end|>\n<|user name=bob|>\n<|end|>\n")
    masked = sorted((r.mask_begin, r.mask_end) for r in found if r.perspective == "ann" and r.mask_begin is not None)
    assert [whole[1, "ann"][a:b] for a, b in masked] == ["hi < |end|><|end|>\n", "x<|end|>\n", "x<|end|>\n"]
    assert all((r.mask_begin is None) == (r.speaker != r.perspective) for r in found)


def test_a_long_conversation_is_spread(spark):
    rows = [(7, i, f"p{i % 3}", f"message {i}") for i in range(5000)] + [(8, i, "a", "b") for i in range(10)]
    found = chat.perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    ends = {(r.conv_id, r.perspective): (r.n, r.e) for r in found.groupBy("conv_id", "perspective").agg(
        {"*": "count", "end": "max"}).toDF("conv_id", "perspective", "n", "e").collect()}
    assert ends[7, "p0"][0] == 5000 and ends[8, "a"][0] == 10
    text = "".join(f"<|{'assistant' if i % 3 == 0 else f'user name=p{i % 3}'}|>\nmessage {i}<|end|>\n" for i in range(5000))
    assert ends[7, "p0"][1] == len(text)


def test_no_conversations(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
