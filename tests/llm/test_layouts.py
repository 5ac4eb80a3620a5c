"""Layouts labelled by hand, none of them from the generator that the model is trained on."""

import re
from collections import Counter

import pytest

from markwright.llm import html_extract as hx

A = "The tide turned before noon, and the boats that had gone out at dawn came home heavy with mackerel."
B = "Nobody on the quay could remember a catch like it, though the older men claimed there had been better years."
C = "Prices fell by half within the hour."
D = "By evening the ice house was full, and what could not be sold was given to whoever came with a basket."
T = "A record day for the harbour"
PARAS = f"<p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p>"
BODY = [A, B, C, D]

LAYOUTS = [
    (f"<body><div id=wrapper><div class=topbar><a href=/>Harbour Times</a> <a href=/log>Log in</a></div><article><h1>{T}</h1>{PARAS}</article><div class=footer>© 2020 Harbour Times</div></div>", [T, *BODY]),
    (f"<nav><a href=/a>News</a><a href=/b>Sport</a></nav><main><h1>{T}</h1>{PARAS}</main><footer><p>All rights reserved.</p></footer>", [T, *BODY]),
    (f"<div class='post'><h2 class='post-title'>{T}</h2><div class='post-body'>{PARAS}</div></div><div id='sidebar'><h3>Popular</h3><ul><li><a href=1>Storm warning</a><li><a href=2>New pier</a></ul></div>", [T, *BODY]),
    (f"<header><div class=logo>HT</div></header><article><h1>{T}</h1><p>{A}<p>{B}<p>{C}<p>{D}</article><section id=comments><h3>2 comments</h3><div class=comment><p>I was there and it was even better than that.</p></div><div class=comment><p>Lovely.</p></div></section>", [T, *BODY]),
    (f"<body><!-- page --><!--><main><h1>{T}</h1>{PARAS}</main><!-- end --></body>", [T, *BODY]),
    (f"<main><h1>{T}</h1><p>{A}</p><!---><p>{B}</p><!-- x --!><p>{C}</p><p>{D}</p></main>", [T, *BODY]),
    (f"<article><h1>{T}</h1><noscript><p>Please turn on scripts to see this page as it was meant.</p></noscript>{PARAS}</article>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p>{A}</p><ins class='adsense'><p>Buy nets at half price from Miller and Sons this week only!</p></ins><p>{B}</p><p>{C}</p><p>{D}</p></article>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p>{A} <ins>Corrected on Monday.</ins></p><p>{B}</p><p>{C}</p><p>{D}</p></article>", [T, A + " Corrected on Monday.", B, C, D]),
    (f"<article><h1>{T}</h1><select><option>Choose a port<option>North<option>South</select>{PARAS}</article>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p style=\"display: none\">You should not be able to read this sentence at all.</p>{PARAS}</article>", [T, *BODY]),
    (f"<article><h1>{T}</h1><div hidden><p>Draft of an earlier version of this story.</p></div>{PARAS}</article>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p class='not hidden here'>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></article>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p>{A}</p><p><a href='/long'>{B}</a></p><p>{C}</p><p>{D}</p></article>", [T, *BODY]),
    (f"<div class=content><h1>{T}</h1>{PARAS}<div class='share-buttons'><a href=#>Share</a><a href=#>Tweet</a></div></div>", [T, *BODY]),
    (f"<div id=cookie-consent><p>We use cookies to make this site work. By going on you agree.</p><button>Fine</button></div><article><h1>{T}</h1>{PARAS}</article>", [T, *BODY]),
    (f"<main><article><header><h1>{T}</h1></header>{PARAS}<aside class=related><h4>Read on</h4><a href=3>The old pier</a></aside></article></main>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p>{A}</p><blockquote>{B}</blockquote><ul><li>{C}</li><li>{D}</li></ul></article><form action=/s><label>Search</label><input></form>", [T, *BODY]),
    (f"<article><h1>{T}</h1><p>{A}</p><table><tr><td>Boats<td>31<tr><td>Tons<td>12</table><p>{D}</p></article>", [T, A, "Boats", "31", "Tons", "12", D]),
    (f"<html><head><title>x</title><body><table><tr><td><a href=1>Home</a><td><a href=2>Archive</a></table><article><h2>{T}</h2>{PARAS}</article>", [T, *BODY]),
    (f"<div role=banner>Harbour Times</div><div role=navigation><a href=1>One</a><a href=2>Two</a></div><div role=main><h1>{T}</h1>{PARAS}</div>", [T, *BODY]),
    (f"<div class='container'><div class='row'><div class='col'><section class='story'><h1>{T}</h1>{PARAS}</section></div></div></div><div class=newsletter><p>Sign up for our letter and never miss a tide.</p><form><input></form></div>", [T, *BODY]),
    (f"<article><h1>{T}</h1><figure><img src=a><figcaption>{C}</figcaption></figure><p>{A}</p><p>{B}</p><p>{D}</p></article><ul class=pagination><li><a href=1>1</a><li><a href=2>2</a></ul>", [T, C, A, B, D]),
    (f"<article><h1>{T}</h1>{PARAS.replace('mackerel', '<b>mackerel</b>').replace('half', '<em>half</em>')}</article><div class=advert>Nets and ropes</div>", [T, *BODY]),
    (f"<article><h1>{T}</h1><h2>Morning</h2><p>{A}</p><p>{B}</p><h2>Evening</h2><p>{C}</p><p>{D}</p></article>", [T, "Morning", A, B, "Evening", C, D]),
    (f"<article><h1>{T}</h1><p>{A}</p><pre>{C}</pre><p>{D}</p></article><dialog><p>Stay a while and subscribe today.</p></dialog>", [T, A, C, D]),
    (f"<script>var a='<p>no</p>'</script><style>p{{}}</style><article><h1>{T}</h1>{PARAS}<script>x()</script></article>", [T, *BODY]),
    (f"<article><h1>{T}</h1>{PARAS}<span style='display:none'>tracking words</span></article>", [T, *BODY]),
    (f"<DIV CLASS='Header'><H3>Harbour Times</H3></DIV><ARTICLE><H1>{T}</H1>{PARAS.replace('p>', 'P>')}</ARTICLE>", [T, *BODY]),
    (f"<main><h1>{T}</h1><div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p><p>{D}</p></div></main><div class='widget'>Weather: fair</div>", [T, *BODY]),
]


def _words(text: str) -> Counter:
    return Counter(re.findall(r"\w+", text))


@pytest.fixture(scope="module")
def model():
    return hx.trained()


def test_layouts_labelled_by_hand(model):
    hit = got = want = 0
    for html, blocks in LAYOUTS:
        found, right = _words(hx.extract_text(html, model)), _words("\n".join(blocks))
        hit, got, want = hit + (found & right).total(), got + found.total(), want + right.total()
    assert 2 * hit / (got + want) >= 0.95


@pytest.mark.parametrize("k", range(4, 14))
def test_markup_that_hides_or_shows(model, k):
    html, blocks = LAYOUTS[k]
    assert hx.extract_text(html, model) == "\n".join(blocks)


def test_comments_and_unclosed_elements_keep_what_follows():
    text = lambda html: [b.text for b in hx.blocks(html)]
    assert text("<p>a<!--><p>b<!---><p>c<!-- x --!><p>d<!-- y --><p>e") == ["a", "b", "c", "d", "e"]
    assert text("<p>a<!-- open <p>b") == ["a"]
    assert text("<p>a<noscript>b</noscript>c<p>d<noscript>e<p>f") == ["a c", "de", "f"]
    assert text("<div hidden><div>a</div>b</div><p>c<span hidden>d</span>e<select><option>f</select>g") == ["c e", "g"]
    assert text("<p data-x='hidden'>a<p class=hidden>b<p title='display:none'>c<p style='DISPLAY : NONE'>d<p>e") == ["a", "b", "c", "e"]
