"""Main text of pages: the parser, the trees, the decoder, held-out accuracy."""

import random
import re
from itertools import product

import numpy as np

from rastercube.llm import html

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now.</div>'
    "<article><h1>Head &amp; more</h1><p><b>Bold start of it.<br><p>One  two\n three &eacute;&#233; words here.</p><p>Be.</p></article>"
    "<footer>&copy; site &middot; more words</footer></body></html>"
)
TEXT = "Head & more\nBold start of it.\nOne two three éé words here.\nBe."


def test_the_usual_page_and_every_cut():
    trees = html.model()
    assert html.main_texts([PAGE, None, ""], trees) == [TEXT, "", ""]
    got = html.main_texts([PAGE[:i] for i in range(len(PAGE))], trees)
    end = PAGE.index("</article>")
    whole = lambda t: re.sub(r"&#?\w*$", "", t).strip()  # noqa: E731  a character reference may be cut off
    assert all(TEXT.startswith(whole(t)) for i, t in enumerate(got) if i < end)
    assert got[end:] == [TEXT] * (len(PAGE) - end)


def bare(page):
    return page.replace(" data-y=1", "").replace(" data-y=0", "")


def test_held_out_accuracy():
    r = random.Random(991)
    pages = [html.training_page(r) for _ in range(200)]
    got = html.main_texts(list(map(bare, pages)), html.model())
    want = list(map(html.marked_text, pages))
    overlap = [2 * len(a & b) / max(1, len(a) + len(b)) for a, b in ((set(g.split("\n")), set(t.split("\n"))) for g, t in zip(got, want, strict=True))]
    assert np.mean(overlap) > 0.97 and np.mean([g == t for g, t in zip(got, want, strict=True)]) > 0.9


P1 = "The council met on Tuesday to discuss the new bridge over the river, which has been planned for years."
P2 = "Work is to begin in spring. Engineers expect the first lane to open within eighteen months of that date."
P3 = "Residents of the northern bank welcomed the decision, while others asked for a second opinion on the cost."
C1 = "I have lived there for years and I cannot wait."
#: (inside the article, what its text is besides the paragraphs P1 and P2 around it)
HAND = [
    ("", []),
    (f"<p>{P3}</p>", [P3]),
    (f"<h2>The cost</h2><p>{P3}</p>", ["The cost", P3]),
    ("<table><tr><th>Year</th><th>Cost</th></tr><tr><td>2024</td><td>12 million</td></tr><tr><td>2025</td><td>15 million</td></tr></table>", ["Year", "Cost", "2024", "12 million", "2025", "15 million"]),
    ("<table><caption>Costs by year</caption><tbody><tr><td>2024<td>12<tr><td>2025<td>15</table>", ["Costs by year", "2024", "12", "2025", "15"]),
    ("<dl><dt>Span</dt><dd>It is 340 metres.</dd><dt>Lanes</dt><dd>There are four.</dd></dl>", ["Span", "It is 340 metres.", "Lanes", "There are four."]),
    ("<dl><dt>Span<dd>340 metres<dt>Lanes<dd>Four</dl>", ["Span", "340 metres", "Lanes", "Four"]),
    ('<figure><img src="b.jpg"><figcaption>The river as seen from the old bridge.</figcaption></figure>', ["The river as seen from the old bridge."]),
    ("<ul><li>four lanes</li><li>two cycle paths</li><li>a tram line</li></ul>", ["four lanes", "two cycle paths", "a tram line"]),
    ("<ol><li>first the piers<li>then the deck</ol>", ["first the piers", "then the deck"]),
    ("<blockquote><p>We have waited long enough for this.</p></blockquote>", ["We have waited long enough for this."]),
    ("<pre><code>cost = span * rate</code></pre>", ["cost = span * rate"]),
    (f"<p>{P3} <a href='/x'>Read the report</a> or <b>call us</b>.</p>", [f"{P3} Read the report or call us."]),
    ("<p>A &lt; B &amp; C&nbsp;&#8211; done&#x21;</p>", ["A < B & C \u2013 done!"]),
    ("<p>One<br>two\n\n  three</p>", ["One two three"]),
    ("<svg class=icon/><p>After an icon that closes itself.</p>", ["After an icon that closes itself."]),
    ("<p>Before <svg><g><svg><text>no</text></svg><text>never</text></g></svg> and after.</p>", ["Before and after."]),
    ("<div><select><option>one<option>two</div><p>After an open list.</p>", ["After an open list."]),
    ("<script>if (a < b) { document.write('<p>no</p>') }</script>", []),
    ("<noscript><p>Turn scripts on.</p></noscript>", []),
    ("<template><p>never shown</p></template>", []),
    ("<form><label>Your mail</label><input><button>Send</button></form>", []),
    ('<div class="newsletter"><p>Get our letter each week.</p><button>Sign up</button></div>', []),
    ("<aside><h3>In brief</h3><p>The old bridge was built in 1931.</p></aside>", []),
    ("<aside>The old bridge was built in 1931 by two firms.</aside>", []),
    ('<div class="ad">Buy a boat now, half price.</div>', []),
    ('<div class="related"><h3>Related</h3><ul><li><a href="/1">Ferry stops</a></li><li><a href="/2">Tram opens</a></li></ul></div>', []),
    ('<nav><ol><li><a href="#a">The plan</a></li><li><a href="#b">The cost</a></li></ol></nav>', []),
    ("<style>p { color: red }</style>", []),
    ("<!-- <p>not this</p> -->", []),
    ("<textarea><p>typed</p></textarea>", []),
    ("<iframe src=x><p>framed</p></iframe>", []),
]
COMMENTS = [
    f'<section class="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>{C1}</p></div></section>',
    f"<section><h2>3 comments</h2><div><b>Ann</b><p>{C1}</p></div><div><b>Bob</b><p>At last!</p></div><div><b>Cy</b><p>Who pays for it, though?</p></div></section>",
    f"<div><h3>Kommentare</h3><div><strong>Ann</strong><p>{C1}</p></div><div><strong>Bob</strong><p>Endlich!</p></div></div>",
    "",
]
SHELLS = ["<article>{}</article>{}", "<main>{}</main>{}", '<div class="content">{}</div>{}', "<div class=wrap><article>{}</article>{}</div>"]


def test_hand_written_pages():
    """Every case in every shell, with and without reader comments: the exact text."""
    pages, want = [], []
    for i, (inside, lines) in enumerate(HAND):
        for j, shell in enumerate(SHELLS):
            body = f"<h1>A new bridge</h1><p>{P1}</p>{inside}<p>{P2}</p>"
            main = shell.format(body, COMMENTS[(i + j) % 4])
            pages.append(
                "<!DOCTYPE html><html><head><title>A new bridge</title></head><body><header><a href='/'>The Daily</a></header><nav><ul><li><a href='/a'>News</a></li><li><a href='/b'>Sport</a></li>"
                f"<li><a href='/c'>Weather</a></li></ul></nav>{main}<footer>&copy; The Daily, all rights reserved.</footer></body></html>"
            )
            want.append("\n".join(["A new bridge", P1, *lines, P2]))
    got = html.main_texts(pages, html.model())
    wrong = [(i // 4, i % 4, g) for i, (g, w) in enumerate(zip(got, want, strict=True)) if g != w]
    assert not wrong, (len(wrong), wrong[:5])


def test_heading_one_paragraph_and_comments():
    """The heading of a short article stays, and comments without a telling name go."""
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A new bridge</h1><p>{P1}</p></article>{COMMENTS[1]}<footer>The Daily</footer></body></html>"
    assert html.main_texts([page], html.model()) == [f"A new bridge\n{P1}"]


def test_deep_pages_take_linear_time():
    """Work per open tag is constant: no part of the stack is searched in vain."""
    import time

    def took(n):
        t = time.process_time()
        html.Page("<div>" * n + "<b><i>" * n + "<p>x</em></u>" * n)
        return time.process_time() - t

    took(500)
    assert took(16000) < 40 * took(1000) + 0.2


def test_trees_learn():
    r = np.random.default_rng(1)
    x = r.random((4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    t = html.Trees(x[:2000], y[:2000], np.ones(2000), trees=20)
    assert ((t.chance(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_decoding_is_optimal_and_consistent():
    r = np.random.default_rng(2)
    for _ in range(40):
        page = html.Page("")
        n = int(r.integers(2, 6))
        page.tag, page.parent = ["x"] * n, [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        page.own = [int(v) for v in r.integers(0, 30, n)]
        p = r.random(n)
        w = 1 + np.sqrt(page.own)

        def score(labels, p=p, w=w):
            return sum(w[i] * np.log((p[i] if x == 1 else 1 - p[i]) + 1e-6) for i, x in enumerate(labels))

        legal = [x for x in product((0, 1, 2), repeat=n) if x[0] == 0 and all((x[page.parent[i]], x[i]) not in {(1, 0), (2, 0), (2, 1)} for i in range(1, n))]
        best = max(map(score, legal))
        keep = html.decode(page, p)
        assert abs(max(score(x) for x in legal if [v == 1 for v in x] == keep) - best) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "plain & text < 3"), (4, "z", "<p" * 5000), (5, "l", PAGE.replace("One", "word " * 50000))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got[1, "u"] == (TEXT, len(TEXT)) and got[2, None] == ("", 0) and got[None, "v"] == ("", 0)
    assert len(got[5, "l"][0]) > 200000 and html.extract(df).count() == 7
    assert html.extract(df.limit(0)).count() == 0
