"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into blocks of running text at block-level tags. Each block has features of its ancestors' tags, of the
words in their class and id, and of its text; the field, decoded by Viterbi, marks the blocks of the article. It is
trained on labelled pages that a seeded generator makes, in which every part of a page is known.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import crf
from cohortloom.llm.common import map_text

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes svg math canvas object".split())
#: What an opening tag closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role|aria-label|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[A-Za-z][a-z]*")
#: Words in class, id and role that speak for and against main text (fixed values).
AGAINST = "ad ads advert advertisement sponsor sponsored promo banner sidebar side menu nav navbar navigation footer header masthead topbar comment comments reply replies disqus cookie consent gdpr notice alert newsletter subscribe signup share social related recommend breadcrumb breadcrumbs pagination pager login search modal popup overlay widget toolbar tags meta copyright legal skip hidden form contact rating poll toc".split()
FOR = "content article post entry main body story text page markdown prose".split()
TAGS = "head title nav header footer aside form article main section div ul ol li table td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button label select textarea noscript dialog details dl body".split()


AGAINST_TAGS, FOR_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "head", "dialog", "noscript", "button")), frozenset(("article", "main"))
TAG_BIT, AGAINST_BIT, FOR_BIT = ({w: 1 << k for k, w in enumerate(x)} for x in (TAGS, AGAINST, FOR))


@dataclass(frozen=True)
class Place:
    """An open element, with what it and its ancestors have: bits of tags and of words, depths of the last that speak against and for main text.

    path is a number that elements of equal tags and words, with equal ancestors, share. All is taken over from the parent in one step, so
    nesting may be of any depth.
    """

    tag: str
    tags: int
    against: int
    good: int
    depth: int
    against_at: int
    good_at: int
    label: str | None
    path: int


ROOT = Place("", 0, 0, 0, 0, -1, -1, None, 0)


def blocks(page: str) -> list[tuple[str, Place, int]]:
    """(text, innermost open element, linked characters) of each leaf block, in page order."""
    out, stack, parts, linked, anchors = [], [ROOT], [], 0, 0
    opened: dict[str, int] = {}
    paths: dict[tuple, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, stack[-1], linked))
        parts, linked = [], 0

    def close(name: str) -> None:
        """Close the innermost element of that name and all in it."""
        while True:
            tag = stack.pop().tag
            opened[tag] -= 1
            if tag == name:
                return

    def open_(name: str, words: frozenset, label: str | None) -> None:
        up = stack[-1]
        depth, against, good = up.depth + 1, sum(AGAINST_BIT.get(w, 0) for w in words), sum(FOR_BIT.get(w, 0) for w in words)
        path = paths.setdefault((up.path, name, words), len(paths) + 1)
        stack.append(Place(
            name, up.tags | TAG_BIT.get(name, 0), up.against | against, up.good | good, depth, depth if against or name in AGAINST_TAGS else up.against_at,
            depth if good or name in FOR_TAGS else up.good_at, up.label if label is None else label, path))
        opened[name] = opened.get(name, 0) + 1

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            linked += len(piece) if anchors else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[5]) == "/", m[3] or m[7] or ""
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "a":
            anchors = 0 if closing else 1
        if name == "br":
            parts.append("\n")
            continue
        if name in INLINE or name in RAW:
            continue
        flush()
        if closing:
            anchors = 0
            if opened.get(name):
                close(name)
            continue
        last = stack[-1].tag
        if last and (last in CLOSES.get(name, ()) or (last == "p" and name in CLOSE_P)):
            close(last)
        if name in VOID:
            continue
        found = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)} if attributes else {}
        open_(name, frozenset(w.lower() for k, v in found.items() if k != "data-y" for w in PIECES.findall(v)), found.get("data-y"))
    flush()
    return out


N_PLACE = len(TAGS) * 2 + len(AGAINST) + len(FOR) + 2
N_FEATURES = N_PLACE + 14


def _place_features(place: Place) -> np.ndarray:
    bits = lambda mask, n: [mask >> k & 1 for k in range(n)]
    own = bits(TAG_BIT.get(place.tag, 0), len(TAGS))
    against, good = place.against_at, place.good_at
    return np.array(bits(place.tags, len(TAGS)) + own + bits(place.against, len(AGAINST)) + bits(place.good, len(FOR)) + [against > good, good >= 0 and against < 0], float)


def features(page: list[tuple]) -> np.ndarray:
    """A row for each block: ancestors' and own tag, class words, text, neighbours."""
    x, n = np.zeros((len(page), N_FEATURES)), len(page)
    total, known = sum(len(b[0]) for b in page), {}
    for k, (text, place, linked) in enumerate(page):
        if place.path not in known:
            known[place.path] = _place_features(place)
        x[k, :N_PLACE], words, ends = known[place.path], text.split(), text[-1] in ".!?…:;\"'”"
        x[k, N_PLACE:] = (
            np.log1p(len(text)), np.log1p(len(words)), min(1.0, linked / len(text)), ends, len(words) < 4, sum(c in ",.;" for c in text) / len(text) * 20,
            "©" in text, sum(c.isdigit() for c in text) / len(text), k / max(1, n - 1), len(text) / max(1, total), k == 0, k == n - 1,
            k > 0 and page[k - 1][1].path == place.path, k < n - 1 and page[k + 1][1].path == place.path)
    return x


SYLLABLES = "an be ca de el fo ga hi in ju ka lo mi no or pa qu re sa te un ve wo xi ya zu ther ing tion ment ung lich ción eau".split()
PLACES = [("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="entry-content"'), ("section", ' class="article-body"'), ("div", ' class="story"'), ("td", ' class="text"'), ("div", "")]


def labelled_page(seed: int) -> str:
    """A made-up page; data-y is 1 on what belongs to its article and 0 elsewhere."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))

    def sentence(low: int = 3, high: int = 22) -> str:
        words = [word() for _ in range(r.randint(low, high))]
        return (" ".join(w + ("," if r.random() < 0.08 else "") for w in words)).rstrip(",").capitalize() + r.choice("....!?")

    def prose(most: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, r.randint(1, most)])))

    def short() -> str:
        return " ".join(word() for _ in range(r.randint(1, 4)))

    def links(n: int) -> str:
        names = [r.choice([word(), short(), r.choice("aeiouyäñé")]) + r.choice(["", "", "", ",", ".", ":", "!"]) for _ in range(n)]
        return "<ul>" + "".join(f'<li><a href="/{word()}">{x}</a></li>' for x in names) + "</ul>"

    def some(*made: str, chance: float = 0.35) -> str:
        return "".join(x for x in made if r.random() < chance)

    def noise() -> str:
        return r.choice([
            f'<div class="{r.choice(["ad", "ads", "advert", "promo", "sponsored", "ad-banner"])}">{prose(2)}</div>', f'<aside class="sidebar"><h3>{short()}</h3>{links(r.randint(1, 5))}<p>{prose(2)}</p></aside>',
            f'<div class="{r.choice(["cookie-notice", "notice", "gdpr consent", "alert"])}"><p>{prose(2)}</p><button>{short()}</button></div>',
            f'<form class="{r.choice(["newsletter", "search", "signup", ""])}"><p>{sentence()}</p><label>{short()}</label><input name="q"><button>{short()}</button></form>',
            f'<div class="{r.choice(["related", "share", "social-links", "tags", "breadcrumb", "pagination"])}">{links(r.randint(1, 5))}</div>', f'<div id="sidebar"><div class="widget"><h4>{short()}</h4><p>{prose(2)}</p></div></div>',
        ])

    def comments() -> str:
        name = r.choice(["comments", "comment-list", "replies", "disqus_thread"])
        return f'<{(t := r.choice(["section", "div"]))} id="{name}"><h3>{short()}</h3>' + "".join(f'<{(c := r.choice(["div", "li", "article"]))} class="comment"><b>{word()}</b><p>{prose(3)}</p></{c}>' for _ in range(r.randint(1, 5))) + f"</{t}>"

    title = sentence(3, 12)
    inner = some(f"<h1>{title}</h1>", chance=0.85) + some(f"<p><b>{title}<br>", chance=0.3)
    for _ in range(r.choice([1, 2, r.randint(1, 14)])):
        inner += r.choices([
            f"<p>{prose(9)}</p>", f"<p>{r.choice([word().capitalize() + '.', sentence(1, 5)])}</p>", f"<h2>{short()}</h2>", f"<p><b>{sentence()}<br>", f"<blockquote><p>{prose()}</p></blockquote>",
            "<ul>" + "".join(f"<li>{sentence(2, 9)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", f"<pre>{short()} = {short()}</pre>", f"<p>{sentence()} <a href='#'>{short()}</a> {sentence()}</p>", f"<figure><figcaption>{sentence(2, 9)}</figcaption></figure>",
            f"<table><tr><td>{short()}</td><td>{r.randint(0, 999)}</td></tr></table>", f"<div>{prose()}</div>"], [12, 3, 2, 2, 1, 1, 1, 2, 0.5, 0.5, 1.5])[0]
        inner += some(f'<div data-y="0">{noise()}</div>', chance=0.06)
    inner += some(f'<div data-y="0">{comments()}</div>', f'<footer data-y="0">{short()} &middot; {short()}</footer>', chance=0.1)
    tag, attributes = r.choice([PLACES[0], r.choice(PLACES)])
    article = f'<{tag}{attributes} data-y="1">{inner}</{tag}>'
    if tag == "td":
        article = f"<table><tr>{article}</tr></table>"
    before = some(f"<header><h2>{short()}</h2><p>{sentence()}</p></header>", f'<div class="{r.choice(["header", "topbar", "masthead"])}">{short()}</div>', f"<nav>{links(r.randint(1, 8))}</nav>", f'<div class="menu">{links(r.randint(2, 8))}</div>', noise(), noise(), f"<noscript>{sentence()}</noscript>")
    after = some(noise(), noise(), comments(), f"<footer>&copy; {word()}.example &middot; {prose(2)}</footer>", f'<div class="footer"><p>{prose(2)}</p>{links(r.randint(0, 4))}</div>')
    page = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{before}{article}{after}"
    return page + some("</body></html>", chance=0.9)


@dataclass
class ArticleModel:
    chain: crf.Chain

    def text(self, page: str) -> str:
        """The blocks of the article, joined by empty lines; empty if none is."""
        found = blocks(page)
        if not found:
            return ""
        marks = crf.viterbi(self.chain, self.chain.emissions(features(found)))
        return "\n\n".join(b[0] for b, y in zip(found, marks, strict=True) if y)


def fit_articles(pages: int = 500, seed: int = 7) -> ArticleModel:
    """Fit the field on so many labelled pages of the seeded generator, on the driver: a constant amount, whatever the table; no given page takes part."""
    made = [b for k in range(pages) if (b := blocks(labelled_page(seed * 100_003 + k)))]
    x = np.vstack([features(b) for b in made])
    y = np.array([block[1].label == "1" for b in made for block in b], int)
    return ArticleModel(crf.fit(x, y, [len(b) for b in made], rounds=120))


def main_text(pages: DataFrame, model: ArticleModel, page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; n_chars counts code points, other columns are ignored.

    A null or empty page gives an empty text; repeated rows and null ids repeat; a page that breaks off is read as far as it
    goes; pages of any length and depth of tags are read whole; an empty table gives none.
    """

    def make():
        def work(found: list[str]) -> dict:
            texts = [model.text(h) for h in found]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_text(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(page).alias("html")), make, "text string, n_chars long", text="html", drop_text=True)
