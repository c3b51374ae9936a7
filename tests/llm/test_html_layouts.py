"""Main text of pages written by hand, in layouts and with words that the labelled pages of the fit don't have."""

import time

import pytest

from folioframe.llm import htmltext

LONG = "The council met on Monday evening to discuss the new bridge, which will cost 4 million and open in spring."
MORE = "Residents who spoke at the meeting said that traffic in the old town, above all at noon, had grown too heavy."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sports</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The Paper. All rights reserved.</p><a href=/p>Privacy policy</a></footer>"
BOTH = f"{LONG} {MORE}"

#: (page, main text)
LAYOUTS = {
    "button in main": ("<main><p>The article says what matters here.</p><button>Buy</button></main>", "The article says what matters here."),
    "signs in one paragraph": ("<article><p>A&#8212;B &lt;tag&gt; &nbsp; x&shy;y &notanentity; &copy 2024</p></article>", "A—B <tag> x\xady ¬anentity; © 2024"),
    "plain article": (f"<body>{NAV}<article><h1>Bridge</h1><p>{LONG}</p><p>{MORE}</p></article>{FOOT}</body>", f"Bridge {BOTH}"),
    "main and aside": (f"<body>{NAV}<main><h1>Bridge</h1><p>{LONG}</p></main><aside><h3>Related</h3><ul><li><a href=1>Old bridge</a></li></ul></aside>{FOOT}", f"Bridge {LONG}"),
    "aside within article": (f"<article><p>{LONG}</p><aside><h4>Related</h4><a href=1>Old bridge</a></aside><p>{MORE}</p></article>", BOTH),
    "form within article": (f"<article><p>{LONG}</p><form action=x><label>E-mail</label><input name=e><button type=submit>Subscribe now</button></form><p>{MORE}</p></article>", BOTH),
    "button that nothing closes": (f"<article><p>{LONG}</p><div><button>Like</div><p>{MORE}</p></article>", BOTH),
    "two buttons": (f"<article><p>{LONG}</p><button>Like<button>Share</button><p>{MORE}</p></article>", BOTH),
    "comments below": (f"<article><h1>Bridge</h1><p>{LONG}</p></article><section id=comments><h2>Comments</h2><div class=comment><p>Great post, thanks!</p></div></section>{FOOT}", f"Bridge {LONG}"),
    "comments within": (f"<article><p>{LONG}</p><p>{MORE}</p><div class=comments><p>I was there and saw it, nobody spoke at all.</p></div></article>", BOTH),
    "cookie notice": (f"<div class=cookie-banner><p>We use cookies to improve your experience.</p><a href=x>Accept</a></div><article><p>{LONG}</p><p>{MORE}</p></article>", BOTH),
    "advert between": (f"<article><p>{LONG}</p><div class=advert><p>Buy now and save 50%</p></div><p>{MORE}</p></article>", BOTH),
    "key words in text": (f"<body>{NAV}<article><h1>Search and privacy</h1><p>The menu of the home page has no search.</p><p>{LONG}</p></article>{FOOT}", f"Search and privacy The menu of the home page has no search. {LONG}"),
    "copyright in text": (f"<body>{NAV}<article><p>{LONG}</p><p>A copyright &copy; lasts for 70 years.</p></article>{FOOT}", f"{LONG} A copyright © lasts for 70 years."),
    "div of content": (f'<body><div class="header"><a href=/>The Paper</a></div><div class="content"><h1>Bridge</h1><p>{LONG}</p><p>{MORE}</p></div><div class="footer">Contact us</div></body>', f"Bridge {BOTH}"),
    "list and quote": (f"<article><p>{LONG}</p><ul><li>Cost: 4 million.</li><li>Opening: spring.</li></ul><blockquote>{MORE}</blockquote></article>", f"{LONG} Cost: 4 million. Opening: spring. {MORE}"),
    "table in article": (f"<article><p>{LONG}</p><table><tr><th>Year</th><th>Cars</th></tr><tr><td>2020</td><td>900</td></tr></table></article>", f"{LONG} Year Cars 2020 900"),
    "links in text": (f"<article><p>{LONG}</p><p>See the <a href=1>report of the council</a> for more, or <a href=2>the plan</a>.</p></article>", f"{LONG} See the report of the council for more, or the plan."),
    "sections": (f"<main><section><h2>Plan</h2><p>{LONG}</p></section><section><h2>Voices</h2><p>{MORE}</p></section></main>", f"Plan {LONG} Voices {MORE}"),
    "figure": (f"<article><p>{LONG}</p><figure><img src=b.png><figcaption>The old bridge in 1910.</figcaption></figure></article>", f"{LONG} The old bridge in 1910."),
    "script and style": (f"<article><style>p {{}}</style><p>{LONG}</p><script>if (a < b) x('</p>')</script></article>", LONG),
    "white space": ("<article><p>One\n\t two&nbsp;&nbsp;three,   and   this is the whole sentence of it.</p></article>", "One two three, and this is the whole sentence of it."),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    html, text = LAYOUTS[name]
    assert htmltext.default_field().text(html) == text


def test_depth_costs_nothing_and_gives_features():
    field, deep = htmltext.default_field(), 400
    html = "<div>" * deep + f"<nav><a href=x>Home</a></nav><article><p>{LONG}</p></article>" + "</div>" * deep
    assert field.text(html) == LONG
    assert htmltext.features(htmltext.blocks(html))[0].count("in:div") == 1
    began = time.time()
    field.text("<div class=a>x" * 200_000)
    assert time.time() - began < 20


def test_features_end_with_their_element():
    inside = [set(f) for f in htmltext.features(htmltext.blocks("<div class=menu><p class=menu>a</p>b</div>c<p>d"))]
    assert ["name:menu" in f for f in inside] == [True, True, False, False]
    assert ["in:p" in f for f in inside] == [True, False, False, True]
