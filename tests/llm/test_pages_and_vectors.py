"""Page and vector operators against brute force."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedledger.llm import embeddings, html_text, warc
from feedledger.llm.files import reading
from feedledger.llm.html_text import main_text
from feedledger.llm.runs import runs

LONG = "The house of the people is in the morning and the water is with them for a day. " * 4


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("no markup " + LONG, " ".join(("no markup " + LONG).split())),
    (f"<nav><p>{LONG}</p></nav><article><h1>Head</h1><p>One &amp; two<br>three <b>b</b>old<p>Next&nbsp;x</article><footer>f</footer>",
     "Head\nOne & two three bold\nNext x"),
    ("<article><p>a</p><aside>no</aside><div class='comments'><p>no</p></div><form>no</form><p>b", "a\nb"),
    ("<body><header>no</header><main><header><h1>T</h1></header><p>x</p><ul><li>one</li><li><a href=x>link</a></li></ul></main>", "T\nx\none"),
    ("<article>x<script>var a='</p><p>';</script><style>p{}</style><!-- <p>no</p> --> y<noscript>no</noscript></article>", "x y"),
    ("<article><div class=ad>no</div><p id='cookie-notice'>no</p><p>1 < 2 &lt; 3</p><p title='a>b'>q</p></article>", "1 < 2 < 3\nq"),
    (f"<div><h2>Short head</h2><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div><div><a href=a>One</a> <a href=b>Two</a></div><p>tail</p>",
     "\n".join(["Short head", LONG.strip(), "Brief.", LONG.strip()])),
    ("<article><p>cut off in a tag <a href='x", "cut off in a tag"), ("<article><p>open comment <!-- x", "open comment"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article><p>a</div></span></p>b</article>", "a\nb"),
])
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<div><p>{LONG}</p></div><div id='comments'><article class='comment-body'><p>no</p></article></div>", LONG.strip()),
    (f"<div><p>{LONG}</p></div><aside><article><p>no</p></article></aside>", LONG.strip()),
    (f"<div><p>{LONG}</p></div><article><p>teaser</p></article>", LONG.strip() + "\nteaser"),
])
def test_minor_articles_do_not_replace_the_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["class='content-with-sidebar'", "class='layout-has-sidebar'", "id='main' class='no-sidebar'"])
def test_wrappers_named_for_what_they_have_are_kept(name):
    assert main_text(f"<div {name}><article><p>{LONG}</p></article></div>") == LONG.strip()
    assert main_text(f"<div {name}><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div>") == LONG.strip()
    assert main_text("<article><p>a</p><div class='post-comments'><p>no</p></div></article>") == "a"


PLAIN = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore. " * 3
HAN = "昔々あるところに人々が住む家がありました" * 12


@pytest.mark.parametrize("page, want", [
    (f"<form id=f><div><p>{LONG}</p></div><input></form>", LONG.strip()),
    (f"<form><div><article><h1>T</h1><p>x</p></article></div></form><form><p>{LONG}</p></form>", "T\nx"),
    (f"<nav><a href=x>One</a><article><h1>T</h1><p>{LONG}</p></article>", f"T\n{LONG.strip()}"),
    (f"<div><nav><a href=x>One</a><section><p>{LONG}</p></section></div>", LONG.strip()),
    (f"<nav><a href=x>One</a><section><p>no</p></section></nav><article>{LONG}</article>", LONG.strip()),
    *((f"<{t} class='{c}'><article><p>{PLAIN}</p></article></{t.split()[0]}>", PLAIN.strip())
      for t, c in (("div", "header-fixed"), ("div", "modal-open"), ("div", "page login"), ("section", "search"))),
    (f"<div><p>{PLAIN}</p><p>{PLAIN}</p></div><div><a href=a>One</a></div>", f"{PLAIN.strip()}\n{PLAIN.strip()}"),
    (f"<div><p>{HAN}</p></div>", HAN), ("<p>One short paragraph.</p>", "One short paragraph."),
    ("<nav><a href=x>One</a></nav><p>One short paragraph.</p><footer>no</footer>", "One short paragraph."),
    *((f"<article><h1>T</h1><p>x</p><div {name}><p>{LONG}</p></div></article>", "T\nx")
      for name in ("class=article-comments", "class=post-comments", "id=commentsection", "class=content-ad", "class=adbox",
                   "class=main-menu", "class=story-sidebar")),
    (f"<article><h1>T</h1><p>x</p></article><div class=thread><p>{LONG}</p></div>", "T\nx"),
    (f"<article><p>x</p></article><div id=comments><article><p>{LONG}</p></article></div>", "x"),
    ("<article><div class='entry-header'><h1>T</h1></div><p class=commentary>x</p></article>", "T\nx"),
])
def test_wrappers_unclosed_containers_and_comments(page, want):
    assert main_text(page) == want


def test_long_pages_are_whole_and_quick():
    big = "<article>" + "<p>the word</p>" * 50_000 + "</article>"
    assert main_text(big).count("\n") == 49_999
    for bad in ("<" * 100_000, "<a \"" * 50_000, "<!--" * 50_000, "&" * 100_000, "<div>" * 3_000 + "x"):
        main_text(bad)


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", "<article>a</article>", 7), (None, None, None, 8), (1, "u", "<article>a</article>", 7)],
                                  "page_id long, url string, html string, text_ int")
    got = html_text.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "a"), (1, "a")]
    assert html_text.extract_text(pages.where("false")).count() == 0


# WARC --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}%0A\n{i}", f"<p>é {i % 40}</p>" * (1 + i % 7)) for i in range(120)]
    rows += [(500, None, None), (501, "u", ""), (None, "u", "alone"), (None, "u", "<p>é 1</p><p>é 1</p>"), (502, "u", "x" * 300_000),
             (503, "u", "WARC/1.1\r\n\r\nbody"), (504, "u", "twice"), (504, "u", "twice")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)


def test_warc_round_trip(pages):
    index = warc.write_warc(pages, frame_bytes=2_000)
    got = sorted(warc.read_warc(index).collect(), key=lambda r: (r.page_id is not None, r.page_id or 0, r.payload_bytes))
    rows = sorted(pages.collect(), key=lambda r: (r.page_id is not None, r.page_id or 0, len((r.html or "").encode())))
    keeper = {}
    for r in rows:
        keeper[r.html or ""] = max(keeper.get(r.html or "") or -1, -1 if r.page_id is None else r.page_id)
    for r, g in zip(rows, got, strict=True):
        payload, top = (r.html or "").encode(), keeper[r.html or ""]
        revisit = top >= 0 and top != r.page_id
        assert (g.page_id, g.url, g.payload_bytes, g.payload_digest) == (r.page_id, r.url, len(payload), warc.base32_sha1(payload))
        assert (g.record_type, g.refers_to) == (("revisit", top) if revisit else ("response", None))
        assert g.payload is None if revisit else bytes(g.payload) == payload
    one = warc.read_warc(index.where("page_id = 502")).collect()
    assert [(r.page_id, len(r.payload)) for r in one] == [(502, 300_000)]


def test_bundles_are_plain_zstandard(pages):
    import zstandard
    bundle = warc.write_warc(pages, frame_bytes=2_000).first().bundle
    with reading(bundle) as f:
        table = warc.read_seek_table(f)
        f.seek(0)
        whole = f.read()
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
    assert len(table) > 1 and len(text) == sum(t[2] for t in table) and text.startswith(b"WARC/1.1\r\n")


def test_empty_warc(pages):
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0


# Vectors -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + rng.standard_normal(24) * (0.1 if i % 3 else 0.6)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(5)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [float("inf")] * 24),
             (2005, [None] + [1.0] * 23), (None, rows[0][1]), (2100, [1.0, 2.0]), (2101, [2.0, 4.0]), (3000, [3e38] * 24), (2200, rows[5][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(3)


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("options", [{}, {"query_block": 2, "vector_block": 64, "pivots": 3}])
def test_top_k(vectors, options):
    rows = {r.vec_id: [int(np.floor(np.float64(x) * 1024)) for x in r.embedding] for r in vectors.collect()
            if r.vec_id is not None and whole(r.embedding)}
    got = {}
    for r in embeddings.top_k(vectors, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 100 == 0}
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in got:
        scores = sorted((-clamp(sum(a * b for a, b in zip(rows[q], v))), i) for i, v in rows.items() if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert embeddings.top_k(vectors.where("false")).count() == 0


def test_pivots_eliminate(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 32)))]
    got = embeddings.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=28, counted=True)
    r = got.select("query_id", "evaluated").distinct().agg(F.count("*"), F.avg("evaluated"), F.min("evaluated")).first()
    assert r[0] == 30 and 10 <= r[2] and r[1] < 300


@pytest.mark.parametrize("options", [{}, {"compared": 8}])
def test_near_duplicate_vectors(vectors, options):
    items = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect()
             if r.vec_id is not None and whole(r.embedding) and any(r.embedding)]
    links, root = {i: 0 for i, _ in items}, {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, (i, a) in enumerate(items):
        for j, b in items[n + 1:]:
            if len(a) == len(b) and (a / np.abs(a).max()) @ (b / np.abs(b).max()) >= 0.95 * np.sqrt(
                    ((a / np.abs(a).max()) ** 2).sum() * ((b / np.abs(b).max()) ** 2).sum()):
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = embeddings.near_duplicate_vectors(vectors, **options).collect()
    assert len(got) == vectors.count()
    found = sum(r.n_links for r in got)
    assert 0.99 * sum(links.values()) <= found <= sum(links.values())
    for r in got:
        assert r.n_links <= links.get(r.vec_id, 0) and r.kept == (r.vec_id == r.component_id or r.vec_id is None)
        assert r.component_id == (find(r.vec_id) if r.vec_id in root else r.vec_id)
    assert embeddings.near_duplicate_vectors(vectors.where("false")).count() == 0


def test_runs_bound_what_is_held():
    import pyarrow as pa
    keys = sorted([1] * 3 + [2] + [3] * 50 + [4] * 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 4]), pa.array(range(i, i + len(keys[i:i + 4])))], ["k", "v"])
               for i in range(0, len(keys), 4)]
    got = list(runs(batches, 10))
    assert [(c[0][0], len(c[0])) for c, over in got if not over] == [(1, 3), (4, 2)]
    crowd = [c for c, over in got if over]
    assert sum(len(c[0]) for c in crowd) == 50 and max(len(c[0]) for c in crowd) <= 16 and {k for c in crowd for k in c[0]} == {3}
