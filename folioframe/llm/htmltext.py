"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two block-level tags, with white space made one space and character
references decoded. Features of a block are the tags of its ancestors, the words of their class, id and role, and its
text's length, links, punctuation and key words. The field has two labels, main text and the rest; weights of features and
of neighbouring labels are fitted to labelled pages by the exact likelihood (forward-backward), and a page's labels are
decoded by Viterbi. The main text is its blocks in page order, joined by one space.

The labelled pages are made here, by `labelled_pages`: layouts of many kinds whose parts are labelled as they are written.

Scanning takes time in proportion to the page: every step moves on in it, and what closes a tag is looked up, not searched.

Defined results: null, empty and tagless pages (their text is one block) are decoded like any other; a page without main
text gives an empty text; tags, quotes, comments and open elements end as in browsers, but a quote that nothing closes ends
at the tag's end; elements nested to any depth give features, each at the cost of what it adds to those around it; what
stands on a button is a form's; text of any length is read whole; repeated rows are extracted each; an empty table gives no
rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements whose content is no text of the page.
SILENT = frozenset(("script", "style", "noscript", "template", "title", "svg", "iframe", "object", "canvas", "math", "audio", "video", "select", "textarea", "head", "button", "datalist"))
RAW = ("script", "style", "noscript", "template", "title", "svg", "iframe", "textarea")
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A new element of a kind closes the open ones of these kinds.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SCOPE = {"li": ("ul", "ol"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "p": ("div", "td", "li", "section", "article", "blockquote", "body"), "thead": ("table",), "tbody": ("table",), "option": ("select",)}
#: Elements that stand in a head; any other one ends it.
OF_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An attribute: a name, and a value that may be in quotes. Slashes and signs out of place are passed over.
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+|(?=>)))?)?""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}
#: Attributes whose words tell what a part of a page is.
NAMES = frozenset(("class", "id", "role", "aria-label", "itemprop"))
#: Elements that tell what the text in them is for; the innermost one counts.
SECTIONS = frozenset("article main nav aside header footer form".split())
PARTS = re.compile(r"[a-z]+")
#: Words and marks of menus, notices and the like; forms of one key stand together, parted by a slash.
KEYS = (
    "©/(c)|copyright|all rights|cookie|privacy|terms of|subscribe|newsletter|sign up/signup/sign in/signin|log in/login|register|share|tweet|facebook|follow|comment|reply/replies|advert|sponsor|promo|related|"
    "read more|menu|search|e-mail/email|password|submit|home|next|previous|posted by|skip to|back to top|click here|accept|·|»"
)
#: A key word tells of a text if it stands there at least once in so many characters.
KEY_RATE = 160


class Element:
    """An open element and those around it; inline ones without names are left out."""

    __slots__ = ("around", "tag", "names", "fresh", "leaf", "parent", "depth", "section")

    def __init__(self, around: Element | None, tag: str, names: str, fresh: tuple[str, ...]):
        self.around, self.tag, self.names = around, tag, names
        self.fresh = fresh  # features that no element around it has
        if around is None:
            self.leaf, self.parent, self.depth, self.section = "-", "-", 0, "-"
        elif tag in INLINE:
            self.leaf, self.parent, self.depth, self.section = around.leaf, around.parent, around.depth, around.section
        else:
            self.leaf, self.parent, self.depth = tag, around.leaf, around.depth + 1
            self.section = tag if tag in SECTIONS else around.section

    def out(self):
        """This element and those around it, innermost first, but for the page itself."""
        at = self
        while at.around is not None:
            yield at
            at = at.around


@dataclass
class Block:
    text: str
    inside: Element  # the innermost open element
    linked: int  # characters inside links

    @property
    def path(self) -> tuple:
        """(tag, names) of the open elements, outermost first."""
        return tuple((e.tag, e.names) for e in self.inside.out())[::-1]


class Scanner:
    """The leaf blocks of a page, in order."""

    def __init__(self, html: str):
        self.out: list[Block] = []
        self.page = Element(None, "", "", ("bias",))
        self.stack: list[tuple[str, Element]] = []
        self.features: set[str] = set()  # of the open elements
        self.places: dict[str, list[int]] = {}  # of each tag's open elements, in the stack
        self.blocks: list[int] = []  # of open elements that are not inline
        self.parts: list[str] = []
        self.links = self.linked = self.silent = 0
        at = 0
        while (start := html.find("<", at)) >= 0:
            kind = html[start + 1 : start + 2]
            if kind.isalpha() and kind.isascii():
                self.read(html[at:start])
                at = self.tag(html, start + 1)
            elif kind == "/" and html[start + 2 : start + 3].isalpha():
                self.read(html[at:start])
                name = TAG_NAME.match(html, start + 2)
                at = self.attributes(html, name.end() if name else start + 2)[0]
                if name and at:
                    self.close(name[0].lower())
            elif kind == "!" or kind == "?" or kind == "/":
                self.read(html[at:start])
                at = self.mark(html, start)
            else:  # a sign that opens nothing is text
                self.read(html[at : start + 1])
                at = start + 1
            if not at:  # the page ends inside a tag or comment
                break
        else:
            self.read(html[at:])
        self.flush()

    def mark(self, html: str, start: int) -> int:
        """A comment, declaration or CDATA section; the place behind it, 0 at the page's end."""
        if html.startswith("<!--", start):
            if html.startswith((">", "->"), start + 4):
                return html.index(">", start) + 1
            end = html.find("-->", start + 4)
            return end + 3 if end >= 0 else 0
        if html.startswith("<![CDATA[", start):
            end = html.find("]]>", start + 9)
            self.read(html[start + 9 : end if end >= 0 else len(html)])
            return end + 3 if end >= 0 else 0
        return html.find(">", start) + 1

    def attributes(self, html: str, at: int) -> tuple[int, str, bool]:
        """(place behind the tag, 0 at the page's end; words of its names; whether it closes itself)."""
        names, n = [], len(html)
        while True:
            found = ATTRIBUTE.match(html, at)
            at, value = found.end(), found[2]
            if found[1] and value and found[1].lower() in NAMES:
                names.append(value.strip("\"'"))
            if at >= n:
                return 0, "", False
            if html[at] == ">":
                return at + 1, " ".join(names).lower(), html[at - 1] == "/" and not value

    def inside(self) -> Element:
        return self.stack[-1][1] if self.stack else self.page

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(Block(text, self.inside(), min(self.linked, len(text))))
        self.parts.clear()
        self.linked = 0

    def read(self, raw: str) -> None:
        if not raw:
            return
        if self.silent and self.stack[-1][0] == "head" and not raw.isspace():  # text ends a head
            self.pop(len(self.stack) - 1)
        if not self.silent:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links > 0:
                self.linked += len(text.strip())

    def push(self, tag: str, names: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        element = self.inside()
        if names or tag not in INLINE:
            fresh = tuple(f for f in element_features(tag, names) if f not in self.features)
            self.features.update(fresh)
            element = Element(element, tag, names, fresh)
        self.stack.append((tag, element))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, element = self.stack.pop()
            if element is not self.inside():
                self.features.difference_update(element.fresh)
            self.places[tag].pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of these, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        at = self.last((tag,))
        if at >= 0 and not (tag in INLINE and self.blocks and self.blocks[-1] > at):
            self.pop(at)

    def tag(self, html: str, start: int) -> int:
        name = TAG_NAME.match(html, start)
        at, names, closed = self.attributes(html, name.end())
        if not at:
            return 0
        tag = name[0].lower()
        if tag not in INLINE:
            self.flush()
        if tag not in OF_HEAD and (head := self.last(("head",))) >= 0:  # ends the head, closed or not
            self.pop(head)
        if tag == "br" or tag in VOID:
            if tag not in INLINE:
                self.parts.append(" ")
            return at
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if closes:
            scope = self.last(SCOPE["p"] if closes == {"p"} else SCOPE.get(tag, ()))
            while (open_ := self.last(closes)) > scope:
                self.pop(open_)
                if tag not in ("tr", "tbody", "thead"):
                    break
        if closed and tag in ("svg", "math"):
            return at
        self.push(tag, names)
        if tag in RAW:
            at = RAW_END[tag].search(html, at).start() or len(html)
        return at


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    return Scanner(html).out


@lru_cache(maxsize=1)
def part_kinds() -> dict[str, list[str]]:
    """The kinds of parts that a word of a name tells of."""
    out: dict[str, list[str]] = {}
    for kind, names in PART_NAMES.items():
        for word in sorted(set(PARTS.findall(names)) - set(PARTS.findall(MAIN_NAMES))):
            out.setdefault(word, []).append(kind)
    return out


@lru_cache(maxsize=10_000)
def element_features(tag: str, names: str) -> tuple[str, ...]:
    """Features that an element gives to the blocks in it."""
    out = {f"in:{tag}"}
    for word in PARTS.findall(names):
        out.add(f"name:{word}")
        out.update(f"stem:{word[:k]}" for k in (3, 5) if len(word) > k)
        out.update(f"kind:{k}" for k in part_kinds().get(word, ()))
    return tuple(sorted(out))


def place_features(inside: Element) -> tuple[str, str, str]:
    return f"leaf:{inside.leaf}", f"parent:{inside.parent}", f"depth:{min(inside.depth, 6)}"


@lru_cache(maxsize=1)
def key_finder():
    """An automaton that finds all keys' forms in one pass over a lower-cased text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for key in KEYS.split("|"):
        for form in key.split("/"):
            found.add_word(form, key)
    found.add_word("|", "bar")
    found.make_automaton()
    return found


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    link = block.linked / n
    out = [f"size:{min(n.bit_length(), 9)}", f"link:{0 if link == 0 else 1 if link < 0.3 else 2 if link < 0.8 else 3}", f"end:{text[-1] if text[-1] in '.!?:;,…' else 'x'}"]
    out.append(f"marks:{min(3, sum(text.count(c) for c in ',.;') * 40 // n)}")
    found = Counter([key for _, key in key_finder().iter(text.lower())])
    keys = [k for k, times in found.items() if times * KEY_RATE > n]
    section = block.inside.section
    return out + [f"key:{k}" for k in keys] + [f"keyed:{section}"] * bool(keys) + [f"key:{section}:{k}" for k in keys]


def features(page: list[Block]) -> list[list[str]]:
    return [["bias", *(f for e in b.inside.out() for f in e.fresh), *place_features(b.inside), *text_features(b)] for b in page]


class Field:
    """Weights of features (for label 1 against 0) and of pairs of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def scores(self, page: list[Block]) -> list[float]:
        """Of each block; an element's score is worked out once, from that of the element around it."""
        get, out = self.weights.get, []
        known: dict[Element | None, float] = {None: 0.0}
        for b in page:
            new, at = [], b.inside
            while at not in known:
                new.append(at)
                at = at.around
            score = known[at]
            for at in reversed(new):
                score = known[at] = score + sum([get(f, 0.0) for f in at.fresh])
            out.append(score + sum([get(f, 0.0) for f in (*place_features(b.inside), *text_features(b))]))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi over the page's blocks."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.pairs.tolist()
        back, a, b = [], 0.0, 0.0
        for i, s in enumerate(self.scores(page)):
            if i:
                from0, from1 = int(a + t00 < b + t10), int(a + t01 < b + t11)
                back.append((from0, from1))
                a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + s
            else:
                b = s
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]

    def text(self, html: str) -> str:
        page = blocks(html)
        return " ".join([b.text for b, y in zip(page, self.decode(page), strict=True) if y])


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 200, rate: float = 0.1, l2: float = 5e-4) -> Field:
    """Maximum likelihood with a Gaussian prior, all pages at a time."""
    names: dict[str, int] = {}
    page_no, place, feature = [], [], []
    longest = max(len(b) for b, _ in pages)
    truth, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, (page, labels) in enumerate(pages):
        truth[i, : len(labels)], real[i, : len(labels)] = labels, True
        for t, found in enumerate(features(page)):
            for f in found:
                page_no.append(i)
                place.append(t)
                feature.append(names.setdefault(f, len(names)))
    cell, feature = np.array(page_no) * longest + np.array(place), np.array(feature)
    n, total = len(pages), real.sum()
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    mean, var = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    both = real[:, 1:]
    seen = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        unary = np.zeros((n, longest, 2))
        unary[..., 1] = np.bincount(cell, weights=w[feature], minlength=n * longest).reshape(n, longest)
        fore, aft = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = unary[:, 0]
        for t in range(1, longest):
            step_in = np.logaddexp(fore[:, t - 1, 0, None] + pairs[0], fore[:, t - 1, 1, None] + pairs[1]) + unary[:, t]
            fore[:, t] = np.where(real[:, t, None], step_in, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = unary[:, t + 1] + aft[:, t + 1]
            step_out = np.logaddexp(pairs[:, 0] + ahead[:, 0, None], pairs[:, 1] + ahead[:, 1, None])
            aft[:, t] = np.where(real[:, t + 1, None], step_out, 0)
        log_z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        p1 = np.exp(fore[..., 1] + aft[..., 1] - log_z[:, None]) * real
        joint = fore[:, :-1, :, None] + pairs + (unary + aft)[:, 1:, None, :] - log_z[:, None, None, None]
        expected = (np.exp(joint) * both[..., None, None]).sum((0, 1))
        off = (truth * real - p1).ravel()
        grad = np.concatenate([np.bincount(feature, weights=off[cell], minlength=len(w)) / total - l2 * w, ((seen - expected) / total - l2 * pairs).ravel()])
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[:-4], pairs + move[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in names.items()}, pairs)


#: Names that sites give to the parts of a page.
PART_NAMES = {
    "menu": "nav navbar navigation menu main-menu topnav nav-list breadcrumb breadcrumbs pagination pager toc tabs site-nav",
    "header": "header site-header masthead top topbar page-header branding logo banner-top hero-bar",
    "footer": "footer site-footer page-footer bottom colophon foot legal copyright footer-links",
    "sidebar": "sidebar side aside rail right-col widget widgets secondary related related-posts recommended popular trending more-stories tags archive",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert message notification paywall disclaimer warning",
    "advert": "ad ads advert advertisement adsense ad-slot sponsor sponsored promo promotion banner promoted affiliate",
    "form": "form signup subscribe newsletter search searchbox login contact register subscription",
    "comments": "comments comment commentlist comment-list comment-body discussion responses replies disqus reactions respond",
    "share": "share sharing social social-links share-buttons follow byline-tools toolbar",
}
#: Marks and references that stand in articles.
MARKS = ["&mdash;", "&lt;tag&gt;", "&amp;", "&nbsp;", "&copy;", "&copy 2024", "&#8212;", "x&shy;y", "&hellip;", "100 %", "(1)", "&unknown", "#1", "2024"]
MAIN_NAMES = "content main main-content article article-body post post-content entry entry-content story story-body text body-text page-content article-text single prose blog-post"
#: Sentences that stand in such parts, besides invented words.
PART_TEXTS = {
    "menu": "Home|News|Sports|About us|Contact|Products|Services|Blog|Archive|Login|Next|Previous|Skip to content",
    "header": "Daily News|The Site|Welcome|Your source for everything|Search|Menu",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Copyright 2023 Example|Powered by the web|Back to top|Imprint|Contact us",
    "sidebar": "Related articles|Most popular|Read more|Tags|Archives|Recent posts|You may also like|Trending now",
    "notice": "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our policy.|Please log in to continue.|Accept all|Your subscription has expired.",
    "advert": "Advertisement|Buy now and save 50%|Sponsored content|Click here for great deals|Limited offer, order today!",
    "form": "Subscribe to our newsletter|Enter your e-mail|Sign up|Submit|Search|Password|Your name",
    "comments": "Leave a reply|Great post, thanks!|Comments (12)|Reply|I totally disagree with this.|Posted by anna 3 days ago|Log in to comment",
    "share": "Share|Tweet|Share on Facebook|Follow us|Print|E-mail this",
}
PART_TAGS = {"menu": ["nav", "div", "ul", "nav"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "div", "section", "aside"], "notice": ["div", "p", "section", "aside"], "advert": ["div", "aside", "p", "ins", "section"], "form": ["form", "div", "form"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "p"]}
SYLLABLES = "an be co da el fi ga ho in ju ka lo mi no or pe ra si ta un ver wo ent ing tion lich que ado ment sch ou".split()


def labelled_pages(n: int = 800, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages of many layouts with each block's label; the same for the same arguments."""
    rng = random.Random(seed)
    pages, forms = [], KEYS.replace("/", "|").split("|")

    def words(low: int, high: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            word = "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
            out.append(word + rng.choices(["", ",", ".", "###", "!!"], [84, 7, 7, 1, 1])[0])
        return " ".join(out).capitalize()

    def sentence(low: int, high: int) -> str:
        return words(low, high).rstrip(".,") + rng.choices([".", "!", "?", ""], [80, 5, 5, 10])[0]

    def named(kind: str) -> str:
        name = rng.choice(PART_NAMES[kind].split())
        return rng.choice(["", f' class="{name}"', f' class="{name} x{rng.randint(1, 9)}"', f' id="{name}"', f' class="{name}-wrap {name}"'])

    def part(kind: str) -> str:
        tag, attrs = rng.choice(PART_TAGS[kind]), named(kind)
        if tag in ("div", "p", "section", "ul", "ol") and not attrs:
            attrs = f' class="{rng.choice(PART_NAMES[kind].split())}"'
        lines = [rng.choice([rng.choice(PART_TEXTS[kind].split("|")), words(1, 4), sentence(5, 25 if kind in ("comments", "advert", "notice", "footer", "sidebar") else 6)]) for _ in range(rng.randint(1, 6))]
        if kind == "comments":
            lines += [sentence(5, 60) for _ in range(rng.randint(0, 3))]
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{rng.choice(['<a href=x>{}</a>', '{}', '<p>{}</p>'] if kind in ('comments', 'sidebar') else ['<a href=x>{}</a>'])}</li>".format(x) for x in lines)
        elif tag == "p":
            inner = lines[0]
        else:
            style = rng.choice(["<p>{}</p>", "<a href=x>{}</a> ", "<span>{}</span> ", "<li><a href=x>{}</a></li>", "<div>{}</div>", "{} ", *(["<label>{}</label><input name=q>"] * 4 if kind == "form" else [])])
            inner = "".join(style.format(x) for x in lines)
            inner = f"<ul>{inner}</ul>" if "<li>" in inner else inner
            if rng.random() < 0.3:
                inner = rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(rng.choice(PART_TEXTS[kind].split("|"))) + inner
            if kind == "form" and rng.random() < 0.6:
                inner += "<input name=q><button>Go</button>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def with_keys(text: str) -> str:
        """Words of menus and notices, and marks, stand in articles too."""
        out = text.split(" ")
        if rng.random() < 0.2:  # columns and lists in a line
            return f" {rng.choice('|·»')} ".join(out)
        for _ in range(rng.randint(1, 3)):
            out.insert(rng.randint(0, len(out)), rng.choice(forms + MARKS))
        return " ".join(out)

    def body() -> list[tuple[int, str]]:
        title = sentence(1, 12) if rng.random() < 0.93 else rng.choice(PART_TEXTS[rng.choice(list(PART_TEXTS))].split("|"))
        out = [(1, f"<h1>{title}</h1>")] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 10])):
            text = sentence(rng.choice([1, 5, 20, 60]), rng.choice([60, 90, 140]))
            if rng.random() < 0.3:
                text = with_keys(text)
            if rng.random() < 0.25:
                text = text.replace(" ", " <b>", 1) + ("</b>" if rng.random() < 0.7 else "")
            if rng.random() < 0.15:
                text = text.replace(" ", " <a href=y>", 1).replace(" ", " </a>", 3)
            if rng.random() < 0.2:
                text += "<br>" + sentence(5, 40)
            kind = rng.choices(["p", "h2", "ul", "quote", "pre", "table", "div", "open"], [60, 7, 6, 5, 2, 3, 8, 12])[0]
            out.append((1, {"p": f"<p>{text}</p>", "h2": f"<h2>{sentence(1, 8)}</h2>", "ul": "<ul>" + "".join(f"<li>{sentence(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>", "quote": f"<blockquote><p>{text}</p></blockquote>", "pre": f"<pre>{text}</pre>", "table": f"<table><tr><td>{sentence(1, 5)}<td>{sentence(1, 5)}</table>", "div": f"<div>{text}</div>", "open": f"<p>{text}"}[kind]))
            if rng.random() < 0.15:
                out.append((0, part(rng.choice(["advert", "share", "sidebar", "notice", "form"]))))
        return out

    for _ in range(n):
        pieces: list[tuple[int, str]] = []
        for kind, chance in (("notice", 0.25), ("header", 0.5), ("menu", 0.8), ("advert", 0.5), ("notice", 0.15), ("sidebar", 0.25), ("form", 0.15)):
            if rng.random() < chance:
                pieces.append((0, part(kind)))
        rng.shuffle(pieces)
        if rng.random() < 0.2:  # a header that holds a menu
            pieces.insert(0, (0, f"<header{named('header')}>{part('menu')}<h1>{words(1, 3)}</h1></header>"))
        tag = rng.choices(["article", "main", "div", "section", "td", ""], [50, 15, 22, 5, 4, 4])[0]
        attrs = f' class="{rng.choice(MAIN_NAMES.split())}"' if tag in ("div", "section", "td") or rng.random() < 0.3 else ""
        inner = body()
        if rng.random() < 0.12:
            inner.append((0, part("comments")))
        if rng.random() < 0.15:
            inner.append((0, part("share")))
        opening, closing = {"td": (f"<table><tr><td{attrs}>", "</td></tr></table>"), "": ("", "")}.get(tag, (f"<{tag}{attrs}>", f"</{tag}>"))
        after = [(0, part(k)) for k, chance in (("share", 0.2), ("sidebar", 0.35), ("comments", 0.35), ("form", 0.2), ("advert", 0.25), ("footer", 0.8)) if rng.random() < chance]
        outer = rng.choice([("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="wrapper"><div class="container">', "</div></div>")])
        marks = [f"\x02{y}\x03" for y in (0, 1)]
        html = "<html><head><title>t</title></head><body>" + outer[0] + "".join(marks[y] + p for y, p in pieces) + opening + "".join(marks[y] + p for y, p in inner) + closing + "".join(marks[y] + p for y, p in after) + outer[1] + rng.choice(["</body></html>", ""])
        page, labels, now = [], [], 0
        for b in blocks(re.sub("\x02([01])\x03", r"<hr><x-mark>\1</x-mark><hr>", html)):
            if b.inside.tag == "x-mark":
                now = int(b.text)
            else:
                page.append(b)
                labels.append(now)
        if page:
            pages.append((page, labels))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field fitted to the labelled pages, once in a process."""
    return fit(labelled_pages())


def extracted(pages: DataFrame, field: Field | None = None, key_columns: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """One row per row of pages: the key columns, text and n_chars."""
    field = field or default_field()
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.pairs))  # as large as the labelled pages' features
    keys = [F.col(c) for c in key_columns]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key_columns) + ", text string, n_chars long"

    def run(batches):
        own = Field(*shared.value)
        for batch in batches:
            texts = [own.text(h) if h else "" for h in batch.column(len(key_columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key_columns)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*key_columns, "text", "n_chars"])

    return pages.select(*keys, F.col(html_column)).mapInArrow(run, schema)
