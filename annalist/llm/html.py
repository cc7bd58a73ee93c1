"""Main text of web pages as a maximum-scoring run of words and tags.

A page is a sequence of text pieces and tags.  A piece has features: the
elements it lies in, the words of their class, id and role, and the length and
link share of its line.  A logistic regression, fitted to labelled pages, gives
every feature a weight; the sum is the score of each of the piece's words,
positive for main text and negative for the rest.  Tags have small negative
scores, the log odds of lying in the main text.  One linear scan finds the run
with the largest sum.  Its pieces with a positive score are the main text:
adverts, notices and forms inside the run have learned negative ones and go.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C

_TOKEN = re.compile(r"""<!--(?s:.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")

#: Fixed values of HTML: elements whose content is raw text, elements without content, elements that break a line of text.
RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that tell nothing by being there, those that hold lines of text, and those whose text no reader sees.
PLAIN = {"html", "body", "div", "span", "center", "font"}
HOLDERS = {"html", "body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "center", "details", "dialog"}
UNSEEN = {"head", "title", "noscript", "template", "svg", "object", "canvas", "audio", "video", "math", "datalist"}
#: The most that a word scores, the words of a line that can count against it, and the least that a tag costs.
MOST, LINE, TAG = 4.0, 15, -0.05

Features = frozenset[str]


@lru_cache(256)
def _kind(tag: str) -> str:
    if tag in ("p", "a", "li", "div"):
        return tag
    return "h" if tag[0] == "h" and tag[1:].isdigit() else "block" if tag in BLOCK else "inline"


class Piece:
    """Text between two tags: its features, whether it lies in a link, in an article or main, the elements that hold it, and what its line adds."""

    __slots__ = ("features", "holders", "inside", "line", "link", "text", "words")

    def __init__(self, text: str, features: Features, link: bool, inside: bool, holders: tuple) -> None:
        self.text, self.features, self.link, self.inside, self.holders = text, features, link, inside, holders
        self.words, self.line = len(text.split()), ""


def _elements(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of every tag; the name is empty for comments and the like."""
    at, end = 0, len(page)
    while found := _TOKEN.search(page, at):
        at = found.end()
        tag, closing = (found[2] or found[5] or "").lower(), bool(found[1] or found[4])
        if tag in RAW and not closing:  # its content is no text
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else end
        yield found.start(), at, closing, tag, found[3] or found[6] or ""


class _Stack:
    """Open elements: (name, start, own features)."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, Features]] = []
        self.names: Counter[str] = Counter()

    def push(self, name: str, start: int, features: Features) -> None:
        self.open.append((name, start, features))
        self.names[name] += 1

    def pop(self) -> tuple[str, int, Features]:
        last = self.open.pop()
        self.names[last[0]] -= 1
        return last

    def close(self, name: str) -> int | None:
        """Close the innermost element of a name and all in it; its start."""
        if not self.names[name]:
            return None
        while (last := self.pop())[0] != name:
            pass
        return last[1]


def _closed(elements: list[tuple]) -> tuple[set[int], bool]:
    """Starts of the elements that their own tag closes, and whether the page has an article or main."""
    stack, closed, proper = _Stack(), set(), False
    for start, _, closing, tag, attributes in elements:
        if closing:
            if (at := stack.close(tag)) is not None:
                closed.add(at)
        elif tag and tag not in VOID and not attributes.endswith("/"):
            stack.push(tag, start, frozenset())
            proper |= tag in ("article", "main")
    return closed, proper


@lru_cache(4096)
def _own(tag: str, attributes: str, inside: bool) -> Features:
    """Features of an element: its name, and the names in class, id and role, whole (``is``) or as a part (``in``)."""
    out = set() if tag in PLAIN else {f"<{tag}"} if tag in ("article", "main") else {f"<{_kind(tag) if _kind(tag) == 'h' else tag}{'@' if inside else ''}"}
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _NAME.findall(name)
            out |= {f"is {parts[0]}"} if len(parts) == 1 else {f"in {p}" for p in parts}
    return frozenset(out)


@lru_cache(1 << 14)
def _with(known: Features, own: Features, proper: bool) -> Features:
    return known - {"outside"} | own | {"inside"} if proper else known | own if own - known else known


def parse(page: str) -> list[Piece | tuple[str, bool]]:
    """The pieces and tags (kind, whether it breaks the line) of a page, in order."""
    elements = list(_elements(page))
    closed, proper = _closed(elements)
    stack = _Stack()
    out: list[Piece | tuple[str, bool]] = []
    known: list[Features] = [frozenset({"outside"} if proper else {"alone"})]  # of all open elements, by depth
    holders: list[tuple] = [()]  # of all open elements, by depth: the innermost one that holds lines, after those around it
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            inside = stack.names["article"] + stack.names["main"] > 0
            out.append(Piece(page[at:upto], known[-1], stack.names["a"] > 0, inside, holders[-1]))

    def push(tag: str, start: int, own: Features) -> None:
        stack.push(tag, start, own)
        known.append(_with(known[-1], own, tag in ("article", "main")))
        holders.append((holders[-1], start) if tag in HOLDERS else holders[-1])

    for start, end, closing, tag, attributes in elements:
        text(start)
        at = end
        if not tag:
            continue
        if closing:
            stack.close(tag)
            del known[len(stack.open) + 1 :], holders[len(stack.open) + 1 :]
        else:
            if tag in ("article", "main") and any(s not in closed for _, s, _ in stack.open):
                # Content proper: what is never closed has ended before it, with what it holds of its name, whose end tag was its own.
                left = {}
                for name, s, _ in stack.open:
                    left.setdefault(name, s not in closed)
                    left[name] |= s not in closed
                rest = [x for x in stack.open if x[1] in closed and not left[x[0]]]
                stack = _Stack()
                del known[1:], holders[1:]
                for x in rest:
                    push(*x)
            elif tag in BLOCK and stack.open and stack.open[-1][0] == "p":
                stack.pop()  # a block ends an open paragraph
                known.pop()
                holders.pop()
            if tag not in VOID and not attributes.endswith("/"):
                inside = stack.names["article"] + stack.names["main"] > 0
                push(tag, start, _own(tag, attributes, inside))
        out.append((_kind(tag), tag in BLOCK))
    text(len(page))
    line: list[Piece] = []
    for x in [*out, ("", True)]:
        if isinstance(x, Piece):
            line.append(x)
        elif x[1] and line:
            words, linked = sum(p.words for p in line), sum(p.words for p in line if p.link)
            share = "none" if not linked else "all" if linked == words else "most" if 2 * linked > words else "some"
            size = next((s for s in (2, 5, 10, 20) if words <= s), "more")
            for p in line:
                where = "@" if p.inside else ""
                p.line = f"links {share}{where}", f"words {size}{where}"
            line = []
    return out


# ---------------------------------------------------------------- labelled pages


def _words(rng: random.Random, words: list[str], least: int, most: int) -> str:
    return " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))


_TEXT = "a plain line of running text that tells the reader what happened and why it matters to them today or will in days to come".split()
_NOISE = "home login sign register subscribe buy offer deal terms privacy policy cookies accept search archive tags follow share print email next previous top advert sponsored account contact".split()
#: Names that pages commonly give to their parts.
_CONTENT = "content|post|entry|article|story|text|main|page-content|post-content|entry-content|article-body|main-content|story-body|post-body|blog-post|news-post|prose|body-text|single-post|rich-text".split("|")
_WRAP = "search-results|related-work|share-price|comment-policy|ad-hoc|menu-planning|social-history|notice-board|login-guide|banner-design|footer-notes|sidebar-left|has-sidebar|with-comments|no-ads|page-wrap|wrapper|container|layout|row|col-8|site|app|root".split("|")
_MENU = "nav|menu|navbar|navigation|main-menu|nav-bar|top-nav|site-nav|breadcrumb|breadcrumbs|toolbar|pager|pagination|skip|skip-link|masthead|site-header|page-header|header|tabs|links|tags|tag-list".split("|")
_BOX = "ad|ads|advert|adverts|advertisement|advertising|ad-box|ad-banner|banner|promo|promoted|promotion|sponsor|sponsored|sponsored-box|related|related-posts|related-articles|more-stories|recommended|read-more|teaser|share|sharing|share-bar|social|social-share|newsletter|newsletter-signup|subscribe|subscription|signup|login|widget|sidebar|side-bar|sidebar-widget|search|search-box|author-bio|popular".split("|")
_NOTICE = "cookie|cookies|cookie-notice|cookie-banner|consent|gdpr|gdpr-banner|notice|notices|site-notice|disclaimer|popup|modal|overlay|popup-overlay|alert".split("|")
_REPLY = "comments|comment|comment-list|comment-body|comments-area|user-comments|discussion|disqus|disqus_thread|replies|reply|respond|responses|reader-comments".split("|")


def labelled_pages(n: int = 1000, seed: int = 3) -> list[tuple[str, str]]:
    """Pages of many layouts with their main text: lists, tables, quotes, code and links in it, and boxes around and inside it."""
    rng = random.Random(seed)

    def named(names: list[str], tags: str) -> tuple[str, str]:
        tag = rng.choice(tags.split())
        attribute = rng.choice(("class", "class", "class", "id"))
        more = f" {rng.choice(('box', 'block', 'item', 'clearfix', 'dark', 'x1'))}" if attribute == "class" and rng.random() < 0.3 else ""
        return f'<{tag} {attribute}="{rng.choice(names)}{more}">', f"</{tag}>"

    def link(words: str) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words}</a>'

    def links(words: list[str], least: int, most: int, size: int = 4) -> str:
        return "<ul>" + "".join(f"<li>{link(_words(rng, words, 1, size))}</li>" for _ in range(rng.randint(least, most))) + "</ul>"

    def prose(words: list[str], least: int, most: int) -> str:
        return f"<p>{_words(rng, words, least, most)}</p>"

    def noise(kind: str) -> str:
        if kind == "menu":
            a, b = rng.choice((("<nav>", "</nav>"), ("<header>", "</header>"), ("<nav>", "</nav>"), named(_MENU, "div ul section"), named(_MENU, "div header")))
            return a + rng.choice((links(_NOISE, 2, 8), prose(_NOISE, 1, 6), " ".join(link(_words(rng, _NOISE, 1, 2)) for _ in range(4)), f"<h1>{_words(rng, _NOISE, 1, 3)}</h1>", f"<div>{_words(rng, _NOISE, 2, 5)}</div>")) + b
        if kind == "form":
            return f"<form><label>{_words(rng, _NOISE, 1, 3)}</label><input name='q'><select><option>{_words(rng, _NOISE, 1, 2)}</option></select><fieldset><legend>{_words(rng, _NOISE, 1, 3)}</legend></fieldset>{prose(_NOISE, 3, 9)}<button>{_words(rng, _NOISE, 1, 2)}</button></form>"
        if kind == "plain":
            return rng.choice(("<div>{}</div>", "<div><div>{}</div></div>", "{}", "<section>{}</section>")).format(rng.choice((links(_NOISE, 1, 8), " ".join(link(_words(rng, _NOISE, 1, 3)) for _ in range(rng.randint(1, 4))), prose(_NOISE, 1, 12), f"<div>{_words(rng, _NOISE, 1, 8)}</div>", f"<h3>{_words(rng, _NOISE, 1, 4)}</h3>")))
        if kind == "button":
            return f"<button>{_words(rng, _NOISE, 1, 3)}</button>"
        if kind == "foot":
            a, b = rng.choice((("<footer>", "</footer>"), ("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>"), ('<div class="site-footer">', "</div>")))
            return a + rng.choice((_words(rng, _NOISE, 3, 12), prose(_NOISE, 4, 25), links(_NOISE, 3, 9))) + b
        if kind == "replies":
            a, b = rng.choice((named(_REPLY, "div section"), named(_REPLY, "section ol div")))
            if rng.random() < 0.5:
                return a + "".join(f'<article class="comment"><header>{_words(rng, _NOISE, 1, 2)}</header>{prose(_NOISE, 4, 60)}</article>' for _ in range(rng.randint(1, 4))) + b
            return a + f"<h3>{_words(rng, _NOISE, 1, 2)}</h3>" + "".join(rng.choice(("<li>{}</li>", '<div class="comment">{}</div>', "<div>{}</div>")).format(prose(_NOISE, 4, 60)) for _ in range(rng.randint(1, 4))) + b
        if kind == "teasers":
            a, b = rng.choice((("<aside>", "</aside>"), named(_BOX, "div section aside")))
            return a + "".join(f"<article><h3>{link(_words(rng, _NOISE, 2, 6))}</h3>{prose(_NOISE, 5, 25)}</article>" for _ in range(rng.randint(1, 3))) + b
        a, b = rng.choice((("<aside>", "</aside>"), named(_BOX, "div section aside div"), named(_BOX, "div section p"), named(_NOTICE, "div section p div"), ('<div role="complementary">', "</div>"), ('<div role="navigation">', "</div>")))
        inner = rng.choice((_words(rng, _NOISE, 2, 30), links(_NOISE, 2, 10, 9), links(_NOISE, 2, 10, 9), prose(_NOISE, 4, 60), f"<b>{_words(rng, _NOISE, 2, 6)}</b>{noise('button')}"))
        return a + (f"<h3>{_words(rng, _NOISE, 1, 3)}</h3>" if rng.random() < 0.4 and not a.startswith("<p") else "") + (re.sub("</?p>", "", inner) if a.startswith("<p") else inner) + b

    def inline(words: str) -> str:
        cut = words.split()
        i = rng.randint(0, len(cut) - 1)
        cut[i] = rng.choice(("<b>{}</b>", "<em>{}</em>", "<i>{}</i>", '<a href="/x">{}</a>', "<code>{}</code>", "<span>{}</span>", "<strong>{}</strong>", "<mark>{}</mark>", "{}")).format(cut[i])
        return " ".join(cut)

    def part() -> str:
        kind = rng.choice(("p", "p", "p", "p", "short", "h", "list", "links", "table", "quote", "code", "figure", "dl", "linked", "div", "section", "ol"))
        own = lambda a, b: inline(_words(rng, _TEXT, a, b))
        if kind == "p":
            return f"<p>{own(10, 70)}.</p>"
        if kind == "short":
            return f"<p>{own(1, 8)}.</p>"
        if kind == "h":
            return f"<h2>{own(1, 6)}</h2>"
        if kind in ("list", "ol"):
            tag = "ul" if kind == "list" else "ol"
            return f"<{tag}>" + "".join(f"<li>{own(1, 14)}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"
        if kind == "links":
            return links(_TEXT, 2, 7)
        if kind == "table":
            return "<table><thead><tr>" + f"<th>{own(1, 2)}</th>" * 2 + "</tr></thead><tbody>" + "".join(f"<tr><td>{own(1, 3)}</td><td>{own(1, 2)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</tbody></table>"
        if kind == "quote":
            return f"<blockquote>{rng.choice(('<p>{}</p>', '{}')).format(own(4, 30))}</blockquote>"
        if kind == "code":
            return f"<pre>{rng.choice(('<code>{}</code>', '{}')).format(_words(rng, _TEXT, 2, 12))}</pre>"
        if kind == "figure":
            return f'<figure><img src="x.png"><figcaption>{own(2, 12)}</figcaption></figure>'
        if kind == "dl":
            return f"<dl><dt>{own(1, 3)}</dt><dd>{own(2, 12)}</dd></dl>"
        if kind == "linked":
            return f"<p>{link(_words(rng, _TEXT, 2, 9))}</p>"
        return f"<{kind}>{own(8, 50)}.</{kind}>"

    pages = []
    for _ in range(n):
        title = _words(rng, _TEXT, 2, 9)
        head = rng.choice((f"<h1>{title}</h1>", f"<h1>{link(title)}</h1>", f"<header><h1>{title}</h1></header>"))
        parts = [head, *(part() for _ in range(rng.randint(1, 9)))]
        if not any(p.startswith(("<p>", "<div>", "<section>")) and len(p) > 90 for p in parts):
            parts.append(f"<p>{_words(rng, _TEXT, 25, 60)}.</p>")
        marked = [(x, True) for x in parts]
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            marked.insert(rng.randint(1, len(marked)), (noise(rng.choice(("box", "box", "box", "form", "button", "teasers"))), False))
        wrap = rng.choice(("<article>", "<article>", "<main>", "<main><article>", "<main><div>", "article", "main", "name", "name", "wrap"))
        if wrap in ("article", "main"):
            opening, closing = f'<{wrap} class="{rng.choice(_CONTENT + _WRAP)}">', f"</{wrap}>"
        elif wrap == "name":
            opening, closing = f'<div class="{rng.choice(_CONTENT)}{rng.choice(("", "", " " + rng.choice(_WRAP)))}">', "</div>"
        elif wrap == "wrap":
            opening, closing = f'<div class="{rng.choice(_WRAP)}">', "</div>"
            marked = [x for x in marked if not x[1] or x[0].startswith(("<h1", "<p", "<header", "<div"))]
        else:
            opening, closing = wrap, "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrap)))
        if wrap in ("name", "wrap"):  # without an article, only prose tells the text from the rest
            marked = [(x.replace("<header>", "").replace("</header>", ""), own) for x, own in marked]
        before = [noise("menu") for _ in range(rng.randint(0, 3))] + [noise(rng.choice(("box", "box", "form", "menu"))) for _ in range(rng.randint(0, 2))]
        after = [noise(rng.choice(("box", "box", "form", "teasers", "menu"))) for _ in range(rng.randint(0, 3))] + [noise("replies") for _ in range(rng.randint(0, 1))] + [noise("foot") for _ in range(rng.randint(0, 1))]
        if wrap not in ("name", "wrap"):  # with one, what lies outside needs no mark
            before += [noise("plain") for _ in range(rng.choice((0, 0, 1)))]
            after = [noise("plain") for _ in range(rng.choice((0, 0, 1)))] + after
        shell = rng.choice(("{}", "{}", "{}", "{}" if wrap in ("name", "wrap") else "<form>{}</form>", '<div class="%s">{}</div>' % rng.choice(_WRAP), '<div id="%s">{}</div>' % rng.choice(_WRAP)))
        body = shell.format("".join([*before, opening, *(x for x, _ in marked), closing, *after]))
        main = "\n".join(line for x, own in marked if own for line in _plain_lines(x))
        pages.append((f"<html><head><title>{_words(rng, _NOISE, 2, 5)}</title></head><body>{body}</body></html>", main))
    return pages


def _plain_lines(markup: str) -> list[str]:
    return _lines(parse(markup), lambda piece: True)


# ---------------------------------------------------------------- weights


def fit_weights(pages: list[tuple[str, str]], ridge: float = 0.01) -> dict[str, float]:
    """Weights of features by logistic regression on the pieces of (page, main text) pairs, and log odds of tags."""
    seen: dict[Features, list[int]] = {}  # pieces of the same features: how many there are, and how many are main text
    inside, outside = Counter(), Counter()
    for page, text in pages:
        known = " ".join(text.split())
        found = parse(page)
        own = [(i, x) for i, x in enumerate(found) if isinstance(x, Piece) and x.words]
        label = [not x.features & UNSEEN_FEATURES and " ".join(entities.unescape(x.text).split()) in known for _, x in own]
        for (_, x), hit in zip(own, label, strict=True):
            tally = seen.setdefault(x.features | {*x.line}, [0, 0])
            tally[0] += 1
            tally[1] += hit
        hits = [i for (i, _), y in zip(own, label, strict=True) if y]
        lo, hi = (hits[0], hits[-1]) if hits else (0, -1)
        for i, x in enumerate(found):
            if not isinstance(x, Piece):
                (inside if lo <= i <= hi else outside)[x[0]] += 1
    names = sorted({f for row in seen for f in row})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(seen), len(names) + 1))
    x[:, -1] = 1
    for i, row in enumerate(seen):
        x[i, [place[f] for f in row]] = 1
    n, y = np.array(list(seen.values()), float).reshape(-1, 2).T
    w = np.zeros(len(names) + 1)
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - n * p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    tags = {f"/{k}": min(TAG, 0.1 * math.log((inside[k] + 0.5) / (outside[k] + 0.5))) for k in inside | outside}
    return {f: float(v) for f, v in zip(names, w, strict=False)} | tags | {"": float(w[-1])}


UNSEEN_FEATURES = {f"<{t}" for t in UNSEEN}


@lru_cache(1)
def weights() -> dict[str, float]:
    return fit_weights(labelled_pages())


def best_run(values: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the largest sum, the first of such; empty where none is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _lines(found: list, keep) -> list[str]:
    """Lines of the pieces that are kept: references decoded, white space single, none empty."""
    out, line = [], []
    for x in [*found, ("", True)]:
        if isinstance(x, Piece):
            if keep(x):
                line.append(x.text)
        elif x[1] and line:
            whole = " ".join(entities.unescape("".join(line)).split())
            if whole:
                out.append(whole)
            line = []
    return out


def _holding(found: list, scores: dict[int, float]) -> dict[int, bool]:
    """Whether an element, or one around it, holds lines of main text itself, by the id of ``holders``."""
    direct = {id(x.holders) for x in found if isinstance(x, Piece) and x.words and scores[id(x)] > 0}
    known: dict[int, bool] = {}
    for x in found:
        if isinstance(x, Piece) and id(x.holders) not in known:
            path, at = [], x.holders
            while at and id(at) not in known:
                path.append(at)
                at = at[0]
            held = known[id(at)] if at else False
            for own in reversed(path):
                held = known[id(own)] = held or id(own) in direct
            known.setdefault(id(x.holders), held)
    return known


def _scores(found: list, weight: dict[str, float]) -> dict[int, float]:
    """The score of each piece's words: what its line has in the mean, and what the lines of the same holder have."""
    own: dict[int, float] = {}
    bases: dict[Features, float] = {}
    sums: dict[int, list[float]] = {}
    lines: list[list[Piece]] = [[]]
    for x in found:
        if not isinstance(x, Piece):
            if x[1] and lines[-1]:
                lines.append([])
        elif x.words:
            if x.features not in bases:
                bases[x.features] = -100.0 if x.features & UNSEEN_FEATURES else weight[""] + sum(weight.get(f, 0.0) for f in x.features)
            own[id(x)] = max(-MOST, min(MOST, bases[x.features] + sum(weight.get(f, 0.0) for f in x.line)))
            lines[-1].append(x)
        else:
            own[id(x)] = MOST  # white space goes with its line
    for line in lines:
        # What is clearly something else, as a button, is judged by itself.
        rest = [x for x in line if own[id(x)] > -MOST / 2]
        if 2 * sum(x.words for x in rest) < sum(x.words for x in line):
            rest = line
        if rest:
            mean = sum(x.words * own[id(x)] for x in rest) / sum(x.words for x in rest)
            for x in rest:
                own[id(x)] = mean
        for x in line:
            held = sums.setdefault(id(x.holders), [0.0, 0])
            held[0] += x.words * own[id(x)]
            held[1] += x.words
    for line in lines:
        for x in line:
            if own[id(x)] > -MOST / 2:
                total, n = sums[id(x.holders)]
                own[id(x)] = max(-MOST, min(MOST, own[id(x)] + total / n))
    return own


def main_text(page: str, weight: dict[str, float]) -> str:
    found = parse(re.sub(r"(?i)<br(?=[\s/>])", " <br", page))
    scores = _scores(found, weight)
    holding = _holding(found, scores)
    values, free = [], False
    for x in found:
        if not isinstance(x, Piece):
            values.append(0.0 if free else weight.get(f"/{x[0]}", TAG))
        elif scores[id(x)] > 0:
            free = free and not x.words
            values.append(x.words * scores[id(x)])
        else:
            # What does not belong costs no more than a tag, however long, beside or within what holds the text, and elsewhere no more than a line.
            near = x.inside or holding[id(x.holders)]
            values.append((0.0 if free else TAG) if near else min(x.words, LINE) * scores[id(x)])
            free = near
    a, b = best_run(values)
    return "\n".join(_lines(found[a:b], lambda p: scores[id(p)] > 0))


def extract(pages: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, url and text (the main text, lines joined by \\n) per row.

    Null and empty html has no text.  Rows may repeat; each is read by itself.
    A page of any length is read whole.  An empty table gives an empty result.
    ``labelled``: pages with their main text, to learn the weights from in place
    of ``labelled_pages()``.
    """
    C.ship(pages.sparkSession)
    weight = fit_weights(labelled) if labelled else weights()
    base = C.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x, weight) for x in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return C.in_arrow(base, run, "page_id long, url string, text string")
