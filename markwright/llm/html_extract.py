"""HTML main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read as a stream of tags with a stack of open elements. The text between two block-level tags is a leaf
block; it knows its ancestor tags, the words in their class and id attributes, and how much of it is link text.
Scripts, styles, text areas, inner frames, the head, comments, what stands in for scripts, lists to choose from and
elements that aren't shown give no blocks. The head ends at its close tag or at the first tag or text that can't stand in
it; drawings, formulas, objects and templates are read as ordinary elements. Each block has features of its ancestors
and of its text; a CRF with the two states boilerplate and main text scores blocks and neighbours, and Viterbi decodes
the page.

The CRF is trained here, on labelled pages from ``training_pages``: pages of various layouts whose main-text blocks
are known by construction (``TRAINING_PAGES`` of them, a documented bound).

Results: null or empty html gives an empty text. Character references are decoded, white space within a block is one
space, blocks join in page order by one ``\\n``; nothing else is dropped or capped. Repeated pages get equal results;
columns named like the results are replaced, others pass through.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TRAINING_PAGES = 320
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9-]*+))")
#: where a comment ends that begins before: at once (``<!-->``, ``<!--->``), or at ``-->`` or ``--!>``
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
#: attributes up to the tag's end; a quote opens a value only after an equals sign. Nothing is tried twice
REST = re.compile(r"""((?>=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
#: elements whose content is no markup: it goes up to the close tag, or to the page's end
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "iframe")}
FOREIGN = frozenset(("svg", "math"))
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
HIDDEN_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("noscript", "template")}
#: elements whose content is for other readers or for choosing from: it is left out if it ends at all
LEFT_OUT = frozenset(("noscript", "select", "datalist"))
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
STYLE = re.compile(r"(?<![^\s/])style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ANCESTORS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "table", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "div", "button", "select", "address", "dialog", "menu", "body", "fieldset", "details")
ANCESTOR_SET = frozenset(ANCESTORS)
HINTS = {
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promoted", "banner", "adbox"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "crumbs", "tabs", "pagination", "pager", "toc"),
    "foot": ("footer", "foot", "copyright", "legal", "colophon", "bottom"),
    "head": ("header", "masthead", "topbar", "branding", "logo", "sitehead", "top"),
    "side": ("sidebar", "side", "aside", "widget", "rail", "related", "recommended", "trending", "popular", "complementary"),
    "remark": ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "thread", "responses"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "signup", "paywall", "disclaimer", "banner"),
    "share": ("share", "sharing", "social", "follow", "tags", "meta", "byline", "author"),
    "form": ("form", "search", "login", "contact", "feedback", "survey"),
    "main": ("article", "post", "entry", "content", "story", "main", "text", "body", "page", "prose", "articlebody"),
}
WORD_HINT = {w: k for k, words in HINTS.items() for w in words}


class Block:
    __slots__ = ("text", "tags", "hints", "linked")

    def __init__(self, text: str, tags: frozenset, hints: frozenset, linked: int):
        self.text, self.tags, self.hints, self.linked = text, tags, hints, linked


def _hints(attributes: str) -> frozenset:
    out = set()
    for values in NAMED.findall(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(values)).lower()):
            if word in WORD_HINT:
                out.add(WORD_HINT[word])
    return frozenset(out)


def _self_closed(attributes: str) -> bool:
    """Whether a slash ends the tag, and not a value without quotes."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"'=]+/\Z", attributes)


def _hidden(attributes: str) -> bool:
    """Whether an element isn't shown: the attribute ``hidden``, or a style without display."""
    low = attributes.lower()
    if "hidden" in low and re.search(r"(?<![^\s/])hidden(?![^\s/=])", VALUE.sub("=", low)):
        return True
    return "none" in low and any(re.search(r"display\s*:\s*none", "".join(m)) for m in STYLE.findall(low))


@lru_cache(maxsize=256)
def _close_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


class Tags:
    """Finds tags, comments and declarations, in time that grows with the page.

    Where quotes hide every further ``>``, tags end at the next one, quoted or not, from there on; past the last ``>``
    only comments are looked for.
    """

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """The next one's start and end, whether it closes, its lower-case name if it has one, its attributes."""
        html = self.html
        while m := OPENING.search(html, at):
            start, name, at = m.start(), m.group(2), m.end()
            if html.startswith("<!--", start):
                end = COMMENT_END.search(html, at)
                return start, end.end() if end else len(html), False, None, ""
            if start > self.last:
                continue
            if name is None:
                return start, html.index(">", start) + 1, False, None, ""
            rest = REST.match(html, at) if self.quotes else None
            if rest:
                return start, rest.end(), bool(m.group(1)), name.lower(), rest.group(1)
            self.quotes = False
            end = html.find(">", at)
            if end >= 0:
                return start, end + 1, bool(m.group(1)), name.lower(), html[at:end]
        return None


def blocks(html: str | None) -> list[Block]:
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, frozenset, frozenset, bool]] = []  # tag, all of ANCESTORS up to it, all hints up to it, hidden
    opened: dict[str, list[int]] = {}  # tag -> its places in the stack
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "head": 0, "hidden": 0, "foreign": 0}
    unclosed: set[str] = set()
    none = frozenset()

    def close_block() -> None:
        if parts:
            text = " ".join(html_module.unescape("".join(parts)).split())
            if text:
                tags, hints = (stack[-1][1], stack[-1][2]) if stack else (none, none)
                out.append(Block(text, tags, hints, state["linked"]))
            parts.clear()
        state["linked"] = 0

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def pop_to(i: int) -> None:
        close_block()
        while len(stack) > i:
            opened[stack.pop()[0]].pop()

    def add(text: str, start: int) -> None:
        if state["head"]:
            if start < state["hidden"] or not text.strip():
                return
            state["head"] = 0  # text can't stand in the head
        if text and not (stack and stack[-1][3]):
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text)

    at, tags_of = 0, Tags(html)
    while found := tags_of.after(at):
        start, end_of_tag, closing, name, attributes = found
        add(html[at:start], at)
        at = end_of_tag
        if name is None:
            continue
        whole_name = not attributes or attributes[0] in " \t\n\r\f\v/"
        if state["head"]:
            if closing and name in ("head", "body", "html") or not closing and start >= state["hidden"] and not (name in IN_HEAD and whole_name):
                state["head"] = 0
            elif not closing and name in HIDDEN_END and whole_name and name not in unclosed and start >= state["hidden"]:
                end = HIDDEN_END[name].search(html, at)
                if end:
                    state["hidden"] = end.end()
                else:
                    unclosed.add(name)
        if name in RAW_END and whole_name and not closing:
            if not _self_closed(attributes):
                end = RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            add(" ", start)
            continue
        if not closing and whole_name and name not in unclosed and (name in LEFT_OUT or name in INLINE and name not in VOID and attributes and _hidden(attributes)):
            end = _close_of(name).search(html, at)
            if end:
                at = end.end()
                add(" ", start) if name in INLINE else close_block()
                continue
            unclosed.add(name)
        if name in FOREIGN and whole_name:
            state["foreign"] = 0 if closing or _self_closed(attributes) else 1
            continue
        if name == "a":
            state["link"] = 0 if closing else 1
            continue
        if name in INLINE and not (name == "ins" and (opened.get(name) if closing else attributes and _hints(attributes))):  # an advert's ins is a block
            if name == "br":
                add(" ", start)
            continue
        if state["foreign"]:
            if name not in ANCESTOR_SET and name not in CLOSES_P and name not in SELF_CLOSING:
                continue
            state["foreign"] = 0  # a tag of the page itself ends a drawing or formula that was left open
        if closing:
            i = last((name,))
            if i >= 0:
                pop_to(i)
            else:
                close_block()
            continue
        if name == "head":
            state["head"] = 1
            continue
        if name in CLOSES_P:
            i = last(("p",))
            if i > last(("td", "th", "button", "object")):
                pop_to(i)
        if name in SELF_CLOSING:
            i = last(SELF_CLOSING[name])
            if i > last(SCOPES[name]):
                pop_to(i)
        close_block()
        if name not in VOID:
            tags, hints, hidden = stack[-1][1:] if stack else (none, none, False)
            if name in ANCESTOR_SET and name not in tags:
                tags = tags | {name}
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, tags, hints | _hints(attributes) if attributes else hints, hidden or bool(attributes) and _hidden(attributes)))
    add(re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", html[at:]), at)  # a tag that the page's end cuts off
    close_block()
    return out


TEXT_FEATURES = ("one", "under3", "under8", "under20", "under50", "long", "stop", "comma", "nolink", "somelink", "halflink", "alllink", "copyright", "upper", "digits", "pipe", "first", "last")
FEATURES = tuple("tag:" + t for t in ANCESTORS) + tuple("hint:" + h for h in HINTS) + TEXT_FEATURES + ("tag:none",)
_NUMBER = {f: i for i, f in enumerate(FEATURES)}
_TAG = {t: _NUMBER["tag:" + t] for t in ANCESTORS}
_HINT = {h: _NUMBER["hint:" + h] for h in HINTS}


@lru_cache(maxsize=4096)
def _path_features(tags: frozenset, hints: frozenset) -> tuple[int, ...]:
    found = [_TAG[t] for t in tags if t in _TAG] + [_HINT[h] for h in hints]
    if not tags & {"article", "main", "nav", "header", "footer", "aside", "form"}:
        found.append(_NUMBER["tag:none"])
    return tuple(sorted(found))


def features(page: list[Block]) -> list[list[int]]:
    out = []
    for k, b in enumerate(page):
        text, n = b.text, b.text.count(" ") + 1
        f = list(_path_features(b.tags, b.hints))
        f.append(_NUMBER["one" if n == 1 else "under3" if n < 3 else "under8" if n < 8 else "under20" if n < 20 else "under50" if n < 50 else "long"])
        share = b.linked / max(1, len(text))
        f.append(_NUMBER["nolink" if share == 0 else "somelink" if share < 0.4 else "halflink" if share < 0.8 else "alllink"])
        if text[-1] in ".!?:;…\"'":
            f.append(_NUMBER["stop"])
        if "," in text:
            f.append(_NUMBER["comma"])
        if "©" in text or "(c)" in text:
            f.append(_NUMBER["copyright"])
        if text[0].isupper():
            f.append(_NUMBER["upper"])
        if text[0].isdigit():
            f.append(_NUMBER["digits"])
        if "|" in text:
            f.append(_NUMBER["pipe"])
        if k == 0:
            f.append(_NUMBER["first"])
        if k == len(page) - 1:
            f.append(_NUMBER["last"])
        out.append(f)
    return out


class Crf:
    """Two states; ``emit[f]`` is feature f's weight for main text against boilerplate, ``move`` the transitions."""

    def __init__(self) -> None:
        self.emit = np.zeros(len(FEATURES))
        self.bias, self.move = 0.0, np.zeros((2, 2))

    def scores(self, rows: list[list[int]]) -> list[float]:
        emit, bias = self.emit.tolist(), self.bias
        return [bias + sum(emit[f] for f in row) for row in rows]

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        off, on, back = 0.0, 0.0, []
        for k, e in enumerate(self.scores(rows)):
            if k == 0:
                off, on = 0.0, e
                continue
            from_off, from_on = off + m01 >= on + m11, off + m00 >= on + m10
            back.append((0 if from_on else 1, 0 if from_off else 1))
            off, on = max(off + m00, on + m10), max(off + m01, on + m11) + e
        state = 1 if on > off else 0
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return path[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 10, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Crf:
        """Stochastic gradient ascent on the conditional log-likelihood (forward-backward for each page)."""
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            step = rate / (1 + epoch / 2)
            for i in rng.permutation(len(pages)).tolist():
                rows, labels = pages[i]
                if not rows:
                    continue
                n = len(rows)
                e = np.zeros((n, 2))
                e[:, 1] = self.scores(rows)
                ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = e[0]
                for k in range(1, n):
                    ahead[k] = np.logaddexp(ahead[k - 1, 0] + self.move[0], ahead[k - 1, 1] + self.move[1]) + e[k]
                for k in range(n - 2, -1, -1):
                    nxt = self.move + e[k + 1] + behind[k + 1]
                    behind[k] = np.logaddexp(nxt[:, 0], nxt[:, 1])
                total = np.logaddexp(*ahead[-1])
                on = np.exp(ahead[:, 1] + behind[:, 1] - total)
                miss = np.array(labels) - on
                self.emit *= 1 - step * decay
                np.add.at(self.emit, np.concatenate([np.array(r) for r in rows]), np.repeat(step * miss, [len(r) for r in rows]))
                self.bias += step * miss.sum()
                if n > 1:
                    both = np.exp(ahead[:-1, :, None] + self.move + (e[1:] + behind[1:])[:, None, :] - total).sum(0)
                    seen = np.zeros((2, 2))
                    np.add.at(seen, (np.array(labels[:-1]), np.array(labels[1:])), 1)
                    self.move += step * (seen - both) / n
        return self


def _prose(rng: np.random.Generator, low: int, high: int) -> str:
    """Invented sentences."""
    parts = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split()
    words = ["".join(rng.choice(parts, size=rng.integers(1, 5))) for _ in range(int(rng.integers(low, high + 1)))]
    out, at = [], 0
    while at < len(words):
        n = int(rng.integers(4, 16))
        sentence = words[at : at + n]
        if len(sentence) > 6 and rng.random() < 0.6:
            sentence[2] += ","
        out.append(" ".join(sentence).capitalize() + rng.choice([".", ".", ".", "!", "?"]))
        at += n
    return " ".join(out)


def _label(rng: np.random.Generator, low: int = 1, high: int = 3) -> str:
    return _prose(rng, low, high).rstrip(".!?")


def training_pages(n: int = TRAINING_PAGES, seed: int = 23) -> list[tuple[str, list[str]]]:
    """(html, its main-text blocks in order): layouts with and without semantic tags, tidy and unclosed markup."""
    rng = np.random.default_rng(seed)
    pages = []
    junk: list[str] = []  # what ends each word of a damaged page's main text

    def spoil(text: str) -> str:
        return " ".join(w + str(rng.choice(junk)) for w in text.split()) if junk else text

    def pick(*options: str) -> str:
        return str(rng.choice(list(options)))

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{i}">{_label(rng)}</a></li>' for i in range(count))

    def boiler(kind: str) -> str:
        if kind == "menu":
            return pick("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<div id="navigation"><ul>{}</ul></div>', '<ul class="nav">{}</ul>', '<div class="breadcrumbs"><ul>{}</ul></div>', "<header><ul>{}</ul></header>").format(links(int(rng.integers(2, 8))))
        if kind == "head":
            return pick("<header><h1>{}</h1><p>{}</p></header>", '<div class="header"><h2>{}</h2><span>{}</span></div>', '<div id="masthead"><div>{}</div><div>{}</div></div>').format(_label(rng), _prose(rng, 2, 9))
        if kind == "foot":
            return pick("<footer>&copy; {} {}</footer>", '<div class="footer"><p>© {}</p><p>{}</p></div>', "<footer><p>{}</p><ul><li>{}</li></ul></footer>", '<div id="bottom">{} | {}</div>').format(_label(rng), _prose(rng, 2, 14))
        if kind == "advert":
            return pick('<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<aside class="sponsored">{}</aside>', '<div id="ads"><a href="/x">{}</a></div>', '<section class="promo"><p>{}</p></section>', '<ins class="adsense"><p>{}</p></ins>').format(_prose(rng, 2, 30))
        if kind == "side":
            return pick("<aside><h3>{}</h3><p>{}</p></aside>", '<div class="sidebar"><h3>{}</h3><p>{}</p></div>', '<div class="related"><h4>{}</h4><ul><li><a href="/r">{}</a></li></ul></div>', '<div class="widget"><div>{}</div><div>{}</div></div>').format(_label(rng), _prose(rng, 3, 40))
        if kind == "notice":
            return pick('<div class="cookie-notice"><p>{}</p><button>{}</button></div>', '<div id="consent">{} <button>{}</button></div>', '<div class="newsletter"><p>{}</p><form><label>{}</label><input></form></div>', '<div class="alert" role="alert"><p>{}</p><span>{}</span></div>', "<dialog><p>{}</p><button>{}</button></dialog>", '<p class="notice">{} {}</p>').format(_prose(rng, 5, 30), _label(rng))
        if kind == "form":
            return pick("<form><p>{}</p><select><option>{}</option></select></form>", '<form class="search"><label>{}</label><button>{}</button></form>', '<div class="login"><form><div>{}</div><div>{}</div></form></div>').format(_prose(rng, 2, 10), _label(rng))
        if kind == "remark":
            inner = "".join(pick("<div class='comment'><b>{}</b><p>{}</p></div>", "<li class='reply'><p>{}: {}</p></li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>").format(_label(rng), _prose(rng, 4, 60)) for _ in range(int(rng.integers(1, 5))))
            return pick('<section id="comments"><h3>{}</h3>{}</section>', '<div class="comments"><h3>{}</h3>{}</div>', '<div class="discussion"><h2>{}</h2>{}</div>').format(_label(rng), inner)
        return f'<div class="share"><a href="#">{_label(rng)}</a> <a href="#">{_label(rng)}</a></div>'

    for _ in range(n):
        main: list[str] = []
        inner: list[str] = []
        junk[:] = ["###", "$$$", "%%%", "***"] if rng.random() < 0.12 else []
        title = spoil(_prose(rng, 3, 12))
        if rng.random() < 0.85:
            inner.append(f"<h1>{title}</h1>" if rng.random() < 0.8 else f"<h2>{title}</h2>")
            main.append(title)
        tidy = rng.random() < 0.7
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.68:
                text = spoil(_prose(rng, 1, 120) if rng.random() < 0.75 else pick(_prose(rng, 1, 4), _label(rng, 1, 3)))
                if rng.random() < 0.06:
                    text = f'<a href="/more">{text}</a>'
                inner.append(f"<p>{text}</p>" if tidy else pick("<p>{}", "<p><b>{}<br>", "<p>{}</p>").format(text))
                text = re.sub("<[^>]*>", "", text)
                main.append(text)
            elif kind < 0.76:
                text = _label(rng, 2, 8)
                inner.append(f"<h3>{text}</h3>" if rng.random() < 0.5 else f"<h2>{text}</h2>")
                main.append(text)
            elif kind < 0.83:
                items = [_prose(rng, 2, 14) for _ in range(int(rng.integers(2, 5)))]
                inner.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                main += items
            elif kind < 0.88:
                text = _prose(rng, 4, 40)
                inner.append(f"<blockquote><p>{text}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>{text}</blockquote>")
                main.append(text)
            elif kind < 0.92:
                cells = [_label(rng, 1, 4) for _ in range(4)]
                inner.append("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells))
                main += cells
            elif kind < 0.95:
                text = _prose(rng, 3, 14)
                inner.append(f"<figure><img src='x.png'><figcaption>{text}</figcaption></figure>")
                main.append(text)
            else:
                inner.append(boiler(pick("advert", "share", "notice", "side")))
        body = "".join(inner)
        wrap = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="post"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', "<div>{}</div>", '<div class="article-body">{}</div>')
        before = [boiler(k) for k in ("notice", "head", "menu", "advert", "form", "side") if rng.random() < 0.45]
        after = [boiler(k) for k in ("share", "side", "remark", "advert", "notice", "form", "menu", "foot") if rng.random() < 0.4]
        end = "" if rng.random() < 0.15 else None  # a page cut off after its main text
        if end == "":
            after = []
            body = body.removesuffix("</p>")
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + "".join(before) + (wrap.format(body) if end is None else wrap.split("{}")[0] + body) + "".join(after) + ("</body></html>" if end is None else end), main))
    return pages


def labelled(pages: list[tuple[str, list[str]]]) -> list[tuple[list[list[int]], list[int]]]:
    out = []
    for html, main in pages:
        page = blocks(html)
        wanted, at, labels = [" ".join(x.split()) for x in main], 0, []
        for b in page:
            hit = at < len(wanted) and b.text == wanted[at]
            labels.append(int(hit))
            at += hit
        out.append((features(page), labels))
    return out


@lru_cache(maxsize=2)
def trained(n: int = TRAINING_PAGES, seed: int = 23) -> Crf:
    return Crf().fit(labelled(training_pages(n, seed)))


def extract_text(html: str | None, crf: Crf) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, on in zip(page, crf.decode(features(page)), strict=True) if on)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """``pages`` with text and n_chars in place of html."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars", "html")]
    shared = pages.sparkSession.sparkContext.broadcast(trained() if crf is None else crf)  # some hundred numbers

    def run(batches: Iterator):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            texts = [extract_text(h, model) for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = StructType(pages.select(*kept).schema.fields + StructType.fromDDL("text string, n_chars long").fields)
    return pages.select(*kept, "html").mapInArrow(run, schema)
