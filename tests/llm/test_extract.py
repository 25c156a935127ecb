from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import extract

FOLDER = DATA.replace("0.001", "0.1")


def article(page):
    """The article by the sample pages' own markup."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside))
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def labeller():
    return extract.train(list(pd.read_parquet(f"{FOLDER}/pages.parquet").html[:240]))


def test_sample(spark):
    out = extract.op8_extract(spark, FOLDER).toPandas().merge(pd.read_parquet(f"{FOLDER}/pages.parquet"), on=["page_id", "url"])
    assert len(out) == 2500 and (out.n_chars == out.text.str.len()).all()
    assert (out.text == out.html.map(article)).mean() > 0.99


OTHER = (
    '<html><body><header><a>Home</a> site</header><div class="cookie-notice">We use things. Accept.</div><div class="main-menu"><ul><li>One<li>Two</ul></div>'
    '<div class="{box}"><h2>A title</h2>{main}</div><aside><p>Other stories here.</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I like this very much, thanks.</p></div></section>'
    "<form><label>Name</label><button>Send</button></form><footer>(c) all rights</footer></body></html>")


@pytest.mark.parametrize("box", ["content", "post-body", "story", "entry"])
def test_other_markup(labeller, box):
    lines = article(pd.read_parquet(f"{FOLDER}/pages.parquet").html[7]).split("\n")[1:8]
    got = extract.main_texts(labeller, [OTHER.format(box=box, main="".join(f"<p>{html.escape(x)}</p>" for x in lines))])[0].split("\n")
    assert set(lines) <= set(got) and not {"I like this very much, thanks.", "We use things. Accept.", "(c) all rights", "Send"} & set(got)


def test_blocks():
    page = '<!DOCTYPE html><body><p>a &amp; <b>b</b>c\n\n d<br>e<script>if (a<b) "</p>"</script><!-- x <p>no --><p title="x>y">f < g<td>h</body>i &#233;'
    assert [t for _, t in extract.blocks(page)] == ["a & bc d", "e", "f < g", "h", "i é"]
    assert extract.blocks("") == [] and extract.blocks("<p><div>") == [] and [t for _, t in extract.blocks('x <a href="y>z')] == ['x z']
    assert len(extract.blocks("<div>" * 2000 + "deep" + "</p>" * 10)) == 1


def test_self_closed_svg():
    def texts(page):
        return [t for _, t in extract.blocks(page)]

    for icon in ('<svg class="i" />', "<svg/>", "<svg a='x>y' b=\"/\"/>", "<SVG viewBox='0 0 1 1' hidden\n/>", "<svg a=1 / />", '<svg width=10/ b="c"/>'):
        assert texts(f"{icon}<article><p>one</p>{icon}<p>two</p></article>") == ["one", "two"], icon
    for icon in ("<svg><text>in</text></svg>", '<svg a="/">in</svg>', "<svg a=b/>in</svg>", "<svg / >in</svg>", "<svg a= />in</svg>", "<script/>in</script>"):
        assert texts(f"{icon}<p>one</p>") == ["one"], icon
    assert texts("<svg-icon>x</svg-icon><p>one</p>") == ["x", "one"]


def test_rule_label():
    def labels(page):
        return [extract.rule_label(p) for p, _ in extract.blocks(page)]

    assert labels('<html class="menu"><head><title>t</title></head><body class="has-sidebar"><form id="aspnetForm"><article><h1 class="entry-title">h</h1><p>x</p><aside>y</aside></article></form>') == [0, 1, 1, 0]
    assert labels('<html><body><div class="sidebar">a</div><form><p>b</p></form><article><form>c</form></article><form class="search"><main>d</main></form></body></html>') == [0, 0, 0, 0]


def test_nothing_to_learn_from():
    labeller = extract.train([])
    assert extract.main_texts(labeller, ["<body><nav>menu</nav><article><p>one</p><p>two</p></article><footer>f</footer>", "bare", ""]) == ["one\ntwo", "bare", ""]


def test_edges(spark, empty_dir, labeller):
    rows = [(1, None, None, "z"), (None, "u", "", "z"), (2, "u", "no tags", "z"), (3, "u", "<article><p>" + "long text. " * 40_000 + "</p></article>", "z"), (3, "u", "<nav>x</nav>", "z"), (4, "u", '<<<"\'>&bogus;<p', "z")]
    out = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labeller).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert max(r.n_chars for r in out) == len("long text. " * 40_000) - 1
    assert extract.op8_extract(spark, empty_dir).count() == 0


def test_gradients():
    """Of the recurrent layers, against differences."""
    rng = np.random.default_rng(1)
    made = extract.Labeller.fresh()
    made.weights = {k: v.astype(np.float64) for k, v in made.weights.items()}
    x, mask = extract.padded([rng.normal(size=(n, extract.SIZE)) for n in (3, 5)])
    y, known = rng.integers(0, 2, mask.shape).astype(float), mask.copy()
    grads = made.gradients(x, mask, y, known)

    def loss():
        out = made.output(x, mask)
        return (np.logaddexp(0, np.where(y > 0, -out, out)) * known).sum() / known.sum()

    for name, grad in grads.items():
        at = tuple(rng.integers(s) for s in grad.shape)
        keep, step = made.weights[name][at], 1e-3
        made.weights[name][at] = keep + step
        up = loss()
        made.weights[name][at] = keep - step
        down = loss()
        made.weights[name][at] = keep
        assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)
