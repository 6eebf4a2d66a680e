import html.parser
import random
from collections import Counter

import numpy as np
import pytest

from lorespark.llm import html_text as h


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="Home page"><!-- x > y -->
    <p>One &amp;amp two&nbsp;<b>three</b><br>four<p>five <a href="a>b">six</a></p>
    <script>if (a < b) "<p>no</p>"</script><ul><li>a<li>b</ul> tail &am</body>"""
    found = h.blocks(page)
    assert [t for _, t, _ in found] == ["One &amp two three four", "five six", "a", "b", "tail &am"]
    assert found[1][0].path() == ["html", "body", ".home", ".page", "p"] and found[1][2] > 0.3
    assert h.blocks("") == [] and h.blocks("<p") and h.blocks("plain")[0][1] == "plain"
    assert h.blocks("<div>" * 3000 + "x")[0][1] == "x"


def test_gradients():
    r = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in h.start_weights(1).items()}
    x, live = h.padded([r.normal(size=(n, h.WIDTH)).astype(np.float32) for n in (3, 1, 5)])
    y = (r.random(live.shape) < 0.5).astype(np.float32)
    loss, grads = h._gradients(x, live, y, w)
    for k in w:
        i = tuple(r.integers(s) for s in w[k].shape)
        moved = {n: v.copy() for n, v in w.items()}
        moved[k][i] += 1e-3
        up = h._gradients(x, live, y, moved)[0]
        assert abs((up - loss) / 1e-3 - grads[k][i]) < 5e-3 * max(1, abs(grads[k][i])), k


def test_held_out_pages():
    w, r = h.trained(), random.Random(12345)
    right = total = 0
    for _ in range(200):
        page, labels = h.generated_page(r)
        found = h.blocks(page)
        assert len(found) == len(labels)
        right += int(((h.label([found], w)[0] >= 0.5) == np.array(labels, bool)).sum())
        total += len(labels)
    assert right / total > 0.985


@pytest.mark.parametrize("kind, least", [("named", 0.99), ("unknown", 0.97), ("bare", 0.97), ("open", 0.97), ("table", 0.97), ("text", 1), ("masked", 0.85)])
def test_names_never_seen(kind, least):
    """Recall of article blocks where the holder's name is made up or missing; no page with
    prose is without text, but for pages whose every name is made up."""
    w, r = h.trained(), random.Random(999)
    kept = total = empty = 0
    for _ in range(120):
        page, labels = h.generated_page(r, kind)
        found = h.blocks(page)
        own = (h.label([found], w)[0] >= 0.5) & np.array(labels, bool)
        kept, total, empty = kept + int(own.sum()), total + sum(labels), empty + (not own.any())
    assert kept / total >= least and (empty == 0 or kind == "masked")


def test_pages_by_hand():
    w = h.trained()
    prose = ["On a thing", "A long paragraph of prose, and then some more of it. " * 6, "Another paragraph, of other words, that ends here. " * 5]
    page = f"<body><h1>{prose[0]}</h1><p>{prose[1]}</p><p>{prose[2]}</p></body>"
    assert (h.label([h.blocks(page)], w)[0] >= 0.5).all()
    assert (h.label([h.blocks(prose[1])], w)[0] >= 0.5).all()


@pytest.mark.parametrize("piece", ["<a ", '<p a="', '<p a=">', "<div>x", "<head>", "<script>", "<b>", "<!--", "<x></y>", "<p><b>", "<li><i>", "</p>"])
def test_malformed_pages_take_linear_time(piece):
    import time

    began = time.process_time()
    found = h.blocks(piece * (1_000_000 // len(piece)) + ">")
    h.vectors(found[:1000])
    assert time.process_time() - began < 10


def test_padding_changes_nothing():
    w, r = h.trained(), random.Random(5)
    pages = [h.blocks(h.generated_page(r)[0]) for _ in range(20)] + [[]]
    for a, b in zip(h.label(pages, w), [h.label([p], w)[0] for p in pages], strict=True):
        assert np.allclose(a, b, atol=1e-5)


class Articles(html.parser.HTMLParser):
    """The article's blocks by the standard library's parser, nothing shared with the operator."""

    LEAVES = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "blockquote", "pre", "table", "tr", "td", "section", "figure", "figcaption", "aside", "article"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.parts, self.blocks = 0, 0, [], []
        self.feed(page)
        self.close()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.flush()
            self.depth += 1
        if not self.depth:
            return
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in self.LEAVES:
            self.flush()

    def handle_endtag(self, tag):
        if not self.depth:
            return
        if tag in ("script", "style"):
            self.skip -= 1
        elif tag in self.LEAVES:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_pages_equal_another_parser(spark, sf, size):
    pages = spark.read.parquet(f"{sf.replace('0.001', size)}/pages.parquet")
    html_of = {r.page_id: r.html for r in pages.collect()}
    for r in h.extract_text(pages).collect():
        assert r.text == "\n".join(Articles(html_of[r.page_id]).blocks) and r.n_chars == len(r.text)


def test_quotes_that_do_not_balance():
    texts = lambda p: [t for _, t, _ in h.blocks(p)]
    assert texts("<p title=don't>hello</p>") == ["hello"]
    assert texts("<p title=don't>hello</p><p>it's</p>") == ["hello", "it's"]
    assert texts('<div class="x>text here</div>') == ["text here"]
    assert texts("<a href='it's.html'>link</a> rest") == ["link rest"]
    assert texts("""<p class=a data-x = 'c>d' b="e>f"g=h>hi</p><p =x>q</p><p a=>z""") == ["hi", "q", "z"]
    assert texts("a < b and <3 c") == ["a < b and <3 c"]
    r = random.Random(3)
    for _ in range(300):
        tags = "".join(r.choice(["<p ", "<b ", "<a ", "</p>", "<br", "x=", "'", '"', ">", " ", "it's", "<i>", "=", "/"]) for _ in range(r.randint(1, 30)))
        assert not any("<" + n in t for t in texts(tags + ">") for n in ("p ", "b ", "a ", "br", "i>"))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav>a</nav>"), (4, "u", "<" * 2000), (5, "u", "<p>" + "word " * 30000), (5, "u", "<p>" + "word " * 30000), (6, "u", "<!-- never closed <p>x")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text int, blocks int")
    got = h.extract_text(pages, blocks_too=True).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.text == "" for r in got if r.page_id in (1, 2, 6))
    assert h.extract_text(pages.limit(0)).collect() == []
