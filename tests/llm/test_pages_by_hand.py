"""Main text of pages written by hand, in layouts that the generator of training pages doesn't make, and a plain twin of the labeller."""

import math
import re

import numpy as np
import pytest

from tracewright.llm import html_extract

P = [
    "The bridge over the northern river was opened to traffic last spring, after four years of work that the city had planned for two.",
    "Engineers had found weak ground beneath the second pillar, and the foundations were laid again from the rock upwards.",
    "Residents of both banks say that the way to work is shorter by half an hour, although the buses still take the old road.",
    "A second crossing further east has been discussed since, but the council hasn't set aside any money for it so far.",
    "What remains is the question of the toll, which was to end once the costs were met; nobody expects that before the decade is out.",
    "In the end the bridge has become what its builders hoped for: a place where people stop and look at the water.",
]

#: Pages in which [[...]] marks a block of the main text.
PAGES = {
    "no classes at all": f"""<html><head><title>Bridge</title></head><body><table><tr><td><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></td></tr></table>
        <h1>[[The bridge is open]]</h1><p>[[{P[0]}]]</p><p>[[{P[1]}]]</p><p>[[{P[2]}]]</p><hr><p><a href="/p">Privacy</a> <a href="/t">Terms</a> <a href="/c">Contact</a></p><p>Copyright 2021 River Press. All rights reserved.</p></body></html>""",
    "nested wrappers": f"""<body><div><div><div><ul><li><a href=a>Start</a></li><li><a href=b>Archive</a></li><li><a href=c>About us</a></li></ul></div></div>
        <div><div><div><div><h2>[[A crossing at last]]</h2><div><p>[[{P[0]}]]</p><div><p>[[{P[3]}]]</p></div><p>[[{P[4]}]]</p></div></div></div></div></div>
        <div><div><p>We use cookies to improve our service. By going on you accept our cookie policy.</p></div></div></div></body>""",
    "semantic tags": f"""<body><header><p>River Press</p><nav><a href=1>World</a><a href=2>Local</a></nav></header><main><article><header><h1>[[Four years for a bridge]]</h1></header>
        <section><p>[[{P[1]}]]</p><p>[[{P[2]}]]</p></section><section><h2>[[What comes next]]</h2><p>[[{P[3]}]]</p></section></article><aside><h3>Most read</h3><ul><li><a href=x>Ten ways to cook rice</a></li><li><a href=y>Storm ahead</a></li></ul></aside></main>
        <footer><p>Imprint</p><p>Subscribe to our newsletter</p></footer></body>""",
    "comments in plain paragraphs": f"""<body><div id="content"><h1>[[The toll stays]]</h1><p>[[{P[4]}]]</p><p>[[{P[0]}]]</p><p>[[{P[5]}]]</p></div>
        <div id="comments"><h3>3 comments</h3><div class="comment"><p>Great read, thanks for sharing this!</p></div><div class="comment"><p>I disagree, the old ferry was much nicer than this.</p></div><div class="comment"><p>First!</p></div></div></body>""",
    "lists and quotes": f"""<body><div class="topbar"><a href=/>Blog</a></div><div class="post"><h1>[[Notes on a bridge]]</h1><p>[[{P[2]}]]</p><blockquote><p>[[{P[5]}]]</p></blockquote><ul><li>[[The pillars stand on rock, forty metres below the water.]]</li><li>[[The deck was floated in on barges, in eleven pieces.]]</li></ul><p>[[{P[3]}]]</p></div>
        <div class="share"><a href=t>Tweet</a><a href=f>Share</a></div><div class="related"><h4>You may also like</h4><a href=r>Another story</a></div></body>""",
    "table layout": f"""<body><table><tr><td width=120><a href=1>Index</a><br><a href=2>Maps</a><br><a href=3>Links</a></td><td><h3>[[A river crossed]]</h3><p>[[{P[0]}]]</p><p>[[{P[1]}]]</p><p>[[{P[5]}]]</p></td></tr><tr><td colspan=2><small>Last updated 4 May. <a href=m>Webmaster</a></small></td></tr></table></body>""",
    "advert between paragraphs": f"""<body><div class="nav-main"><a href=1>Home</a></div><div class="story-body"><h1>[[The weak ground]]</h1><p>[[{P[1]}]]</p><div class="ad-slot"><p>Advertisement</p><p>Buy now and save 50% on shoes!</p></div><p>[[{P[2]}]]</p><p>[[{P[4]}]]</p></div></body>""",
    "form and login": f"""<body><form action=login><label>Name</label><input name=n><label>Password</label><input name=p><p>Forgot your password?</p></form><div class="entry-content"><h1>[[Half an hour less]]</h1><p>[[{P[2]}]]</p><p>[[{P[3]}]]</p><p>[[{P[0]}]]</p></div><form><p>Sign up for our weekly letter</p></form></body>""",
    "unclosed tags": f"""<body><ul class=menu><li><a href=1>Top<li><a href=2>New</ul><div class=article><h1>[[An end to waiting]]</h1><p>[[{P[5]}]]<p>[[{P[4]}]]<p>[[{P[1]}]]</div><div class=footer><p>&copy; 2020<p>Terms of use</div>""",
    "short article": f"""<body><nav><ul><li><a href=1>Home</a></li><li><a href=2>Shop</a></li></ul></nav><article><h1>[[In brief]]</h1><p>[[{P[3]}]]</p></article><footer><p>All rights reserved</p></footer></body>""",
    "sidebar first": f"""<body><div class="sidebar"><h3>Categories</h3><ul><li><a href=1>Cities</a></li><li><a href=2>Rivers</a></li></ul><h3>About the author</h3><p>She writes about towns and water.</p></div><div class="main"><h1>[[Town and river]]</h1><p>[[{P[0]}]]</p><p>[[{P[2]}]]</p><p>[[{P[5]}]]</p></div></body>""",
    "words between lines": f"""<body><div class="header"><h2>Daily</h2></div><div class="content"><h1>[[Eleven pieces]]</h1>[[{P[0]}]]<br><br><p>[[{P[1]}]]</p><p>[[{P[4]}]]</p></div><div class="bottom"><p>Follow us on social media</p></div></body>""",
}


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train()


def test_blocks_of_hand_made_pages(labeller):
    """Nearly every block of layouts that no training page has gets its right label; figures go to the README."""
    right = total = kept = wanted = 0
    for name, page in PAGES.items():
        blocks = html_extract.blocks_of(page)
        truth = np.array(["[[" in b.text for b in blocks], bool)
        for b in blocks:
            b.text = b.text.replace("[[", "").replace("]]", "")
        got = np.asarray(html_extract.label(labeller, [blocks])[0], bool)
        for b, t, g in zip(blocks, truth, got, strict=True):
            if t != g:
                print(f"{name}: {'lost' if t else 'kept'}: {b.text[:70]}")
        right, total = right + (got == truth).sum(), total + len(truth)
        kept, wanted = kept + (got & truth).sum(), wanted + truth.sum()
    print(f"{right} of {total} blocks right, {kept} of {wanted} of the main text kept")
    assert right >= 0.9 * total and kept >= 0.95 * wanted


def plain_scores(model, x):
    """The forward pass of one page, unit by unit and step by step, from the model's weights."""
    w, n = model.w, html_extract.HIDDEN
    sigmoid = lambda z: 1 / (1 + math.exp(-z))

    def run(side, rows):
        h, c, out = [0.0] * n, [0.0] * n, []
        for row in rows:
            z = [float(w[side + "_b"][j]) + sum(float(row[i]) * float(w[side + "_x"][i, j]) for i in np.flatnonzero(row)) + sum(h[i] * float(w[side + "_h"][i, j]) for i in range(n)) for j in range(4 * n)]
            gate = {name: z[k * n : (k + 1) * n] for k, name in enumerate(("i", "f", "o", "g"))}
            c = [sigmoid(gate["f"][k]) * c[k] + sigmoid(gate["i"][k]) * math.tanh(gate["g"][k]) for k in range(n)]
            h = [sigmoid(gate["o"][k]) * math.tanh(c[k]) for k in range(n)]
            out.append(h)
        return out

    fore, back = run("fore", x), run("back", x[::-1])[::-1]
    return [sum(v * float(w["out"][k, 0]) for k, v in enumerate(f + b)) + float(w["out_b"][0]) for f, b in zip(fore, back, strict=True)]


def test_forward_pass_equals_a_plain_one(labeller):
    page = re.sub(r"\[\[|\]\]", "", PAGES["semantic tags"])
    blocks = html_extract.blocks_of(page)
    x = html_extract.vectors(blocks)
    want = [s > 0 for s in plain_scores(labeller, x)]
    assert [bool(g) for g in html_extract.label(labeller, [blocks])[0]] == want
