import html
import random
import re

import hand_pages
import numpy as np
import pytest

from quillspark.llm import _pages as p
from quillspark.llm import html_extract as h


def texts(page):
    return [t for _, t, _ in p.blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style><script>var t="</p>";x(9);</script></head><body>
    <!-- <p>no</p> --><div class="ad big" id='x1'>Ad &amp;
      more&nbsp;here</div><p><b>One<br>two<p>three <a href="a>b">li<i>n</i>k</a> end<ul><li>a<li>b</ul>tail &lt;x&gt; <textarea>hid</textarea>"""
    assert texts(page) == ["Ad & more here", "One two", "three link end", "a", "b", "tail <x>"]
    found = p.blocks(page)
    assert found[0][0][-4:] == ("div", "c.ad", "c.big", "i.x") and found[2][2] == 4
    assert "b" not in found[2][0]


@pytest.mark.parametrize("page", ["", "  ", "plain text", "<", "<p", "</p></p>", "<p>a</div>b", "<!-- open", "<script>x", "a<b>c</b", "<p " + "x" * 5000, "<div>" * 3000 + "deep", "&bogus; &#99999999; &#x41;"])
def test_damaged_pages_do_not_fail(page):
    for _, t, n in p.blocks(page):
        assert t == " ".join(t.split()) and t and 0 <= n <= len(t)


@pytest.mark.parametrize(
    "page",
    [
        "<article><svg><use/></svg><p>one</p><p>two</p></article>",
        "<article><svg><g><circle r='1'><rect/></g></svg><p>one</p><svg/><p>two</p></article>",
        "<article><svg><svg><line></svg>x</svg><p>one</p><math><mi>x<mspace/></math><p>two</p></article>",
        "<article><svg><circle><p>one</p><p>two</p></article>",
        "<article><svg><foreignObject><div>no</div></foreignObject></svg><p>one</p><p>two</p></article>",
        "<html><head><title>No</title><meta charset=utf-8><p>one</p><p>two</p>",
        "<head><link href=x><script>x()</script>one<div>two</div>",
        "<head><style>a{}</style><a href=x>one</a><p>two",
    ],
)
def test_hidden_elements_end_where_they_do(page):
    assert texts(page) == ["one", "two"]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = h.Labeller(3, size=h.SIZE, hidden=4)
    rows = [(rng.standard_normal((n, h.SIZE)).astype(np.float32), list(rng.integers(0, 2, n))) for n in (5, 3)]
    x, mask, y = h.padded(rows)
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64)
    _, g = m.gradients(x, mask, y)
    for k, v in m.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old, e = v[at], 1e-4
        v[at] = old + e
        up = m.gradients(x, mask, y)[0]
        v[at] = old - e
        down = m.gradients(x, mask, y)[0]
        v[at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), k


def test_labels_against_loops():
    """The forward pass as loops over single numbers, and the way of long pages."""
    from math import exp, tanh

    m, (found, _) = h.Labeller(5, hidden=3), p.labelled(3, 1)[0]
    x, w = h.features(found), m.w
    sig = lambda z: 1 / (1 + exp(-z))
    logits = [float(w["c"][0])] * len(x)
    for d, part in (("f", 0), ("b", 3)):
        state, cell = [0.0] * 3, [0.0] * 3
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [float(w[f"b{d}"][j]) + sum(float(a) * float(b) for a, b in zip(x[t], w[f"x{d}"][:, j])) + sum(s * float(b) for s, b in zip(state, w[f"h{d}"][:, j])) for j in range(12)]
            cell = [sig(z[3 + j]) * cell[j] + sig(z[j]) * tanh(z[9 + j]) for j in range(3)]
            state = [sig(z[6 + j]) * tanh(cell[j]) for j in range(3)]
            logits[t] += sum(s * float(w["o"][part + j, 0]) for j, s in enumerate(state))
    want = [sig(z) for z in logits]
    assert len(found) > 5 and np.allclose(m.labels([x])[0], want, atol=1e-4)
    assert np.allclose(m.long_labels(found), want, atol=1e-4)


def test_long_pages_in_stretches(monkeypatch):
    m = h.trained()
    pages = ["".join(s for s, _ in p.made_page(random.Random(k))) for k in range(12)]
    whole = h.main_texts(m, pages)
    monkeypatch.setattr(h, "TOGETHER", 5)
    assert h.main_texts(m, pages) == whole


def test_deep_pages_lose_nothing():
    page = "".join(f'<div class="c{"x" * (k % 3)} d e f g h i j k l">{k} ' for k in range(900))
    found = p.blocks(page)
    assert [t for _, t, _ in found] == [str(k) for k in range(900)]
    assert "c.l" in found[0][0] and max(len(path) for path, _, _ in found) <= 2 * p.ENDS * 12


def test_made_pages_that_it_has_not_seen():
    m, wrong, n = h.trained(), 0, 0
    test = p.labelled(12345, 150)
    for (_, y), got in zip(test, m.labels([h.features(b) for b, _ in test])):
        wrong += ((got >= 0.5) != np.array(y)).sum()
        n += len(y)
    assert n > 2000 and wrong < 0.01 * n


@pytest.mark.parametrize("k", range(len(hand_pages.PAGES)))
def test_pages_written_by_hand(k):
    """Comments, asides, notices, forms and adverts inside articles go; text in cells of a layout and on pages without holders stays."""
    page, want = hand_pages.PAGES[k]
    assert h.main_texts(h.trained(), [page]) == [want]


def test_labels_do_not_depend_on_the_company():
    m = h.trained()
    pages = [h.features(b) for b, _ in p.labelled(7, 30) if b]
    for a, b in zip(m.labels(pages), [m.labels([x])[0] for x in pages]):
        assert np.allclose(a, b, atol=1e-4)


def article(page):
    part = page.partition("<article>")[2].partition("</article>")[0]
    return "\n".join(x for t in re.split(r"</?p>|</?h1>", part) if (x := " ".join(html.unescape(re.sub(r"</?b>|<br>", " ", t)).split())))


def test_whole_table(spark, sf):
    got = {r.page_id: r for r in h.op3_html_extract(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    right = sum(got[r.page_id].text == article(r.html or "") for r in rows)
    assert right >= 0.98 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_edges(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "v", "<article><p>Some words of an article stand here, and then more of them.</p></article>"), (2, "w", "<nav><a>x</a></nav>"), (3, "x", "<article>" + "<p>Word after word of it.</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, h.html_extract(pages).collect()), key=repr)
    assert len(got) == 5 and (1, "u", "", 0) in got and (1, None, "", 0) in got and (2, "w", "", 0) in got
    assert any(r[0] is None and r[2].startswith("Some words") for r in got)
    assert any(r[0] == 3 and r[2].count("\n") == 4999 for r in got)
    assert h.html_extract(pages.limit(0)).count() == 0
