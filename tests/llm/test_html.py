import numpy as np
import pytest

from folioscope.llm import html_blocks, html_extract, html_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now</div>
<article><h1>Caf&eacute; &amp; bar</h1><p>First <b>bold</b>
 part.<br><p>Second 1 &lt; 2 &nbsp; here.</p></article><footer>&copy; 2024</footer>"""


@pytest.fixture(scope="module")
def net():
    return html_extract.labeller()


def test_blocks_of_broken_markup():
    assert [b.text for b in html_blocks.blocks(PAGE)] == ["Home", "News", "Buy now", "Café & bar", "First bold part.", "Second 1 < 2 here.", "© 2024"]
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text(None) == text("") == text("<p></p> \n") == []
    assert text("a < b <p>c</i>d<!-- never ends") == ["a < b", "cd"]
    assert text("<script>x") == [] and text("<div title='a>b'>x</div>") == ["x"]
    assert text('<a href="x>never <p>y') == ["never", "y"]
    assert text("<p>one<p>two<ul><li>a<li>b</ul>c") == ["one", "two", "a", "b", "c"]
    assert text("<b>" * 3000 + "deep" + "</b>" * 3000) == ["deep"]
    assert html_blocks.blocks("<div class='Side-bar x' id=y><a>l</a>ink</div>")[0].path == ("div", ".side", ".bar", ".x", ".y", "a")


HAND = """<html><body><div class="menu"><a href=/>Home</a> <a href=/n>News</a></div><div class="content"><h1>The old harbour</h1>
<p>The harbour was built in 1820 by the town and has been in use since.</p><figure><img src=h.png><figcaption>The harbour in spring</figcaption></figure>
<p>It holds forty boats.</p><dl><dt>Depth</dt><dd>Four metres.</dd></dl><p>See <a href=/map>the map</a>.</p></div><div class="footer">All rights reserved</div></body></html>"""


def test_figures_lists_and_linked_paragraphs_stay(net):
    want = "The old harbour|The harbour was built in 1820 by the town and has been in use since.|The harbour in spring|It holds forty boats.|Depth|Four metres.|See the map."
    assert net.main_texts([HAND])[0].split("\n") == want.split("|")


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<font>y" * 100_000, "</b><i>z" * 100_000, "<li>q</ul>" * 50_000, "<x" * 100_000])
def test_unclosed_tags_take_linear_time(net, page):
    import time

    began = time.process_time()
    found = html_blocks.blocks(page)
    assert net.paths(found).shape == (len(found), html_extract.PATH_DIM)
    assert time.process_time() - began < 20


def test_layouts_not_seen(net):
    """Fitted without opaque containers, measured on them: context and words carry most of it."""
    other = html_extract.fit(800, layouts=("telling", "semantic", "bare"), epochs=4)
    right = total = 0
    for seed in range(88_000_000, 88_000_100):
        markup, main = html_pages.made_page(seed, ("opaque",))
        found = html_blocks.blocks(markup)
        (p,) = other.probabilities([found])
        right += sum((x >= 0.5) == (b.text in main) for b, x in zip(found, p, strict=True))
        total += len(found)
    assert right / total > 0.85


def test_main_text(spark, net):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, "clash"), (3, "u", "", "clash"), (None, "u", PAGE, "clash"), (4, "u", "<article>" + "<p>Some words here.</p>" * 5000 + "</article>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df, net).collect()}
    assert got[1] == got[None] == "Café & bar\nFirst bold part.\nSecond 1 < 2 here." and got[2] == got[3] == ""
    assert got[4] == "\n".join(["Some words here."] * 5000)
    assert html_extract.extract(df.limit(0), net).count() == 0


def test_unseen_made_pages(net):
    right = total = 0
    for seed in range(77_000_000, 77_000_150):
        markup, main = html_pages.made_page(seed)
        found = html_blocks.blocks(markup)
        (p,) = net.probabilities([found])
        right += sum((x >= 0.5) == (b.text in main) for b, x in zip(found, p, strict=True))
        total += len(found)
    assert right / total > 0.99


def test_probabilities_do_not_depend_on_the_batch(net):
    pages = [html_blocks.blocks(html_pages.made_page(s)[0]) for s in range(5, 25)]
    for page, together in zip(pages, net.probabilities(pages), strict=True):
        assert np.allclose(net.probabilities([page])[0], together, atol=1e-4)


def test_gradients_by_differences():
    net = html_extract.fit(20, epochs=1)
    pages, y = [], []
    for s in (1, 2, 3):
        markup, main = html_pages.made_page(s)
        pages.append(html_blocks.blocks(markup))
        y.append(np.array([b.text in main for b in pages[-1]], dtype="f4"))
    g = html_extract._gradients(net, pages, y)

    def loss():
        out = []
        for page, want in zip(pages, y, strict=True):
            p = np.clip(net.probabilities([page])[0].astype(float), 1e-7, 1 - 1e-7)
            out += (-(want * np.log(p) + (1 - want) * np.log(1 - p))).tolist()
        return np.mean(out)

    for name in ("x0", "h0", "x1", "h1", "b1", "path", "out", "skip"):
        w, i = net.w[name], np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, e = w[i], 3e-3
        w[i] = old + e
        up = loss()
        w[i] = old - e
        down = loss()
        w[i] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[name][i]), rel=0.05, abs=2e-5), name
