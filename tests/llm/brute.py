"""Plain Python versions of the operators' contracts."""

import hashlib
import math
import re
from collections import defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    return {i: (min(g)[1], len(g), sha(norm)) for norm, g in groups.items() for _, i in g}


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near_items(docs, items, size=13, span=26):
    windows = {(frozenset(w[k : k + size]), str(i)) for i, text in items for w in [words(text)] for k in range(max(1, len(w) - size + 1) if w else 0)}
    out = {}
    for i, text in docs:
        w, found = words(text), set()
        places = defaultdict(list)
        for k, x in enumerate(w):
            places[x].append(k)
        for terms, item in windows:
            if item not in found and all(t in places for t in terms):
                rare = min(terms, key=lambda t: len(places[t]))
                if any(terms <= set(w[s : s + span]) for p in places[rare] for s in range(max(0, p - span + 1), p + 1)):
                    found.add(item)
        out[i] = sorted(found)
    return out


class Article(HTMLParser):
    """Text of a page's article, for pages whose main part is an article and has no other parts in it but those named."""

    APART = {"nav", "aside", "footer", "header", "form", "script", "style", "figure"}
    LINE = set("a abbr b bdi bdo cite code em i mark q s small span strong sub sup u".split())

    def __init__(self, html):
        super().__init__()
        self.on = self.off = 0
        self.parts, self.divs = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        if tag == "div":
            self.divs.append(any(k == "class" and v and re.search("ad$|comment|share|related", v) for k, v in attrs))
        self.off += tag in self.APART or tag == "div" and self.divs[-1]
        if tag not in self.LINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.on -= tag == "article"
        self.off -= tag in self.APART or tag == "div" and bool(self.divs) and self.divs.pop()
        if tag not in self.LINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.on > 0 and self.off <= 0:
            self.parts.append(data)


def article(html):
    return " ".join("".join(Article(html).parts).split())


def base_licenses(text):
    w, places, labels = words(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_detections(text, rules):
    flat = " " + " ".join(words(text)) + " "
    every = []
    for label, priority, keyword, pattern in rules:
        if keyword in flat:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", flat):
                start = flat.count(" ", 0, m.start()) - 1
                every.append((start, start + m.group().count(" ") + 1, priority, label))
    beats = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and e[1] - e[0] > d[1] - d[0])
    return sorted(d for d in every if not any(beats(e, d) for e in every))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_classes(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


class KneserNey:
    """Interpolated Kneser-Ney over the characters of padded words, as a recursion over orders."""

    def __init__(self, texts, order, discount, alphabet):
        self.order, self.d, self.alphabet = order, discount, alphabet
        raw = {k: defaultdict(int) for k in range(1, order + 1)}
        for w in (w for t in texts for w in self.words(t)):
            for end in range(2, len(w) + 1):
                for k in range(1, min(order, end) + 1):
                    raw[k][w[end - k : end]] += 1
        self.n = {order: dict(raw[order])}
        for k in range(order - 1, 0, -1):
            left = defaultdict(set)
            for gram in raw[k + 1]:
                left[gram[1:]].add(gram)
            self.n[k] = {g: len(left[g]) or c for g, c in raw[k].items()}
        self.total, self.kinds = defaultdict(float), defaultdict(int)
        for k in range(1, order + 1):
            for g, c in self.n[k].items():
                self.total[k, g[:-1]] += c
                self.kinds[k, g[:-1]] += 1

    @staticmethod
    def words(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        out, word = [], ""
        for old, c in zip(text or "", low):
            if old.isalpha():
                word += c
            elif word:
                out.append(word)
                word = ""
        return ["\x01" + w + "\x02" for w in out + [word] * bool(word)]

    def p(self, gram):
        k, total, n = len(gram), self.total[len(gram), gram[:-1]], self.n[len(gram)].get(gram, 0)
        if k == 1:
            kinds = len(self.n[1])
            return max((max(n - self.d, 0) + self.d * kinds / self.alphabet) / max(1, total), 0.1 / self.alphabet / max(1, total))
        back = self.d * self.kinds[k, gram[:-1]] / total if total else 1.0
        return (max(n - self.d, 0) / total if total else 0.0) + back * self.p(gram[1:])

    def entropy(self, text):
        n, total = 0, 0.0
        for w in self.words(text):
            for end in range(2, len(w) + 1):
                n += 1
                total -= math.log(self.p(w[max(0, end - self.order) : end]))
        return total / max(1, n), n


def removed(rows, n=50):
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            if first.setdefault(raw[s : s + n], i) < i:
                cover[s : s + n] = b"\x01" * n
        spans = sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(raw), sum(cover), spans, sha(bytes(c for c, v in zip(raw, cover) if not v)))
    return out
