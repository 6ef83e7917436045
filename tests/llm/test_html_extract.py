"""Whole pages: what is content and what is not, and the labelling against all others."""

import itertools

import pytest

from massflow.llm import html_extract as H

ONE = "The river ran high that spring, and the two villages agreed to share the mill until summer came back."
TWO = "Nobody wrote the agreement down. It was kept for forty years by people who met at the bridge."
P = f"<p>{ONE}</p><p>{TWO}</p>"
BOTH = f"{ONE}\n{TWO}"
AD = "<p>Ten lamps that every kitchen needs, and the seventh one will surprise you and all your friends.</p>"
SAID = "<p>I liked this a lot and I will send it to my friends at the office, who know the place.</p>"

KEPT = [
    f"<body class='single-post has-sidebar'><article>{P}</article></body>",
    f"<body class='single-post has-sidebar menu-open'>{P}</body>",
    f"<div class='layout no-sidebar'>{P}</div>",
    f"<article class='post comment-open'>{P}</article>",
    f"<div class='elementor-widget-container'>{P}</div>",
    f"<div class='elementor-widget elementor-widget-text-editor'>{P}</div>",
    f"<article><section id='legal-history'>{P}</section></article>",
    f"<article class='post related-topic'>{P}</article>",
    P.replace("<p>", "<p title='the hidden truth'>"),
    f"<div data-hidden='false'>{P}</div>",
    P.replace("<p>", '<p class="x>', 1),
    P.replace("<p>", "<p class='x>", 1),
    P.replace("<p>", '<p title="a > b">', 1),
    f"<form><article>{P}</article></form>",
    f"<div class='post-body with-comments'>{P}</div>",
    f"<main><div><div><section>{P}</section></div></div></main>",
    f"<table><tr><td>{P}</td></tr></table>",
    f"<article><header><p>{ONE}</p></header><p>{TWO}</p></article>",
    f"<noscript><article>{P}</article>",
    f"<svg><article>{P}</article>",
    P + "<p class=",
]
LEFT_OUT = [
    f"<nav>{AD}</nav>{P}",
    f"<header class='site'>{AD}</header><main>{P}</main>",
    f"<main>{P}</main><footer>{AD}</footer>",
    f"<aside>{AD}</aside><main>{P}</main>",
    f"<div id='sidebar'>{AD}</div><main>{P}</main>",
    f"<div class='left-sidebar'>{AD}</div>{P}",
    f"<div class='cookie-notice'>{AD}</div><article>{P}</article>",
    f"<article>{P}</article><div class='site-footer'>{AD}</div>",
    f"<article>{P}<div class='ad'>{AD}</div></article>",
    f"<article>{P}<div hidden>{AD}</div></article>",
    f"<article>{P}<div style='color: red; display : none'>{AD}</div></article>",
    f"<article>{P}<div aria-hidden=true>{AD}</div></article>",
    f"<article>{P}</article><div role='complementary'>{AD}</div>",
    f"<article>{P}<form>{AD}<label>Email</label><button>Send</button></form></article>",
    f"<article>{P}</article><section class='comments'>{SAID}</section>",
    f"<article>{P}</article><ol class='comment-list'><li>{SAID}</li><li>{SAID}</li></ol>",
    f"<main>{P}<div><h2>Comments</h2>{SAID}</div></main>",
    f"<main>{P}<div><h3>3 Kommentare</h3><div>{SAID}</div><div>{SAID}</div></div></main>",
    f"<main>{P}<div><div>{SAID}<a>Reply</a></div><div>{SAID}<a>Reply</a></div></div></main>",
    f"<script>var a = '{AD}'</script><style>p > a {{}}</style><template>{AD}</template>{P}",
    f"<article>{P}</article><ul class='related-posts'><li><a href='/a'>One more story</a></li><li><a href='/b'>Another</a></li></ul>",
    f"<!-- {AD} --><article>{P}<!-- never closed {AD}",
]


@pytest.mark.parametrize("page", KEPT + LEFT_OUT)
def test_the_article_and_nothing_else(page):
    assert H.main_text(page)[0] == BOTH


def test_formulas_and_references_stay():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is the length of the whole rope&nbsp;&mdash; it&#39;s twelve feet, &lt;no more&gt;.</p></article>"
    assert H.main_text(page)[0] == "The sum a+b is the length of the whole rope — it's twelve feet, <no more>."


def test_long_page():
    page = "<article>" + "".join(f"<p>Sentence number {k} of a very long page, which goes on and on.</p>" for k in range(3000)) + "</article>"
    text, n, kept = H.main_text(page)
    assert n == kept == 3000 and text.count("\n") == 2999


def test_labels_are_the_best_of_all_labellings():
    """Whole pages: no other labelling of the blocks costs less."""
    for page in [p for p in KEPT + LEFT_OUT]:
        found = H.blocks(page)
        z, ties = [H.evidence(b) for b in found], H._ties(found)

        def loss(keep):
            return sum(max(v, 0) if not k else max(-v, 0) for v, k in zip(z, keep)) + sum(c for i, j, c in ties if keep[i] != keep[j])

        best = min(loss(m) for m in itertools.product([False, True], repeat=len(found)))
        assert loss(H.min_cut(z, ties)) == pytest.approx(best, abs=1e-6)
