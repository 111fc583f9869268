"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, runs of text between block-level tags, in page order. Each block is a vector: hashed
parts of its tag path (tags, and words of class, id and role), hashed words, and a few lengths. A bidirectional LSTM in
numpy reads the whole sequence, so every block is judged with the page before and after it, and gives the probability
that the block is main text. Blocks over one half are joined by line ends.

The labeller is trained here, on pages that ``sample_page`` makes up: articles of many layouts among menus, headers,
footers, sidebars, notices, adverts, forms and reader comments. A third of the pages have telling class names, a third
have names that say nothing, and a third have none; articles also come in table cells, bare divs and nested boxes.
Training is seeded, takes some seconds on the driver, and the few hundred kilobytes of weights go to the executors.
``tests/llm/pages_by_hand.py`` holds pages that were written by hand and not trained on.

Head, script, style and other elements that are never shown hold no blocks; a head whose end tag is left out ends where
text or a tag stands that can't be in one. Formulas, drawings' texts and what objects fall back to are read. Character
references are decoded, white space inside a block becomes one space, line breaks count as white space, and nothing is
capped.

Defined results: null, empty or tagless-and-blank pages give an empty text; broken and cut-off markup is read as far as
it goes; repeated rows are extracted row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, record, rows_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
#: Elements whose text is never shown.
HIDDEN = frozenset("head script style noscript template iframe canvas audio video datalist title annotation annotation-xml desc metadata defs symbol".split())
#: Elements that hold raw text up to their own end tag.
RAW = frozenset("script style noscript template iframe title textarea".split())
#: What can stand in a head; any other tag, and text, ends one whose end tag is left out.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: Drawings and formulas; a tag in them that ends in a slash is a whole element.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd "
    "svg g path rect circle ellipse line polyline polygon use image".split()
)
#: A new one of the first ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PATH, WORDS, EXTRA, HIDDEN_SIZE = 256, 256, 8, 16


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path parts, characters inside links) of each leaf block."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    path: tuple[str, ...] | None = None
    linked = links = hidden = 0

    def flush() -> None:
        nonlocal text, path, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((joined, path or (), linked))
        text, path, linked = [], None, 0

    def pop() -> None:
        nonlocal hidden, links
        tag, _ = stack.pop()
        hidden -= tag in HIDDEN
        links -= tag == "a"

    def end_head() -> None:
        while any(t == "head" for t, _ in stack):
            pop()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at and stack and stack[-1][0] == "head" and not page[at:stop].isspace():
            end_head()
        if stop > at and not hidden:
            piece = html_module.unescape(page[at:stop])
            text.append(piece)
            if path is None and not piece.isspace():
                path = tuple(p for _, parts in stack for p in parts)
            if links:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if hidden and not closing and tag not in IN_HEAD:
            end_head()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or rest.endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, _ in stack)):
            continue
        if tag not in INLINE and stack:
            ended = ENDS.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in HIDDEN:
                at = end.end() if end else size
                continue
        names = [w for m in NAMES.finditer(rest) for g in m.groups() if g for w in PART.findall(g.lower())]
        stack.append((tag, (tag, *("." + w for w in names))))
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    return out


_BUCKETS: dict[str, int] = {}


def _bucket(s: str, n: int) -> int:
    found = _BUCKETS.get(s)
    if found is None:
        if len(_BUCKETS) > 200_000:
            _BUCKETS.clear()
        found = _BUCKETS[s] = zlib.crc32(s.encode("utf-8", "surrogatepass"))
    return found % n


def vectors(page_blocks: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    out = np.zeros((len(page_blocks), PATH + WORDS + EXTRA), np.float32)
    n = len(page_blocks)
    for k, (text, path, linked) in enumerate(page_blocks):
        row = out[k]
        outer = "", ""
        for p in path:
            row[_bucket(p, PATH)] = 1
            if p[0] != ".":
                outer = outer[1], p
        row[_bucket(outer[0] + ">" + outer[1], PATH)] = 1
        words = text.lower().split()
        share = 2 / len(words)
        for w in words:
            row[PATH + _bucket("w " + w.strip(".,:;!?()"), WORDS)] += share
        np.minimum(row[PATH:], 0.5, out=row[PATH:])  # a word said over and over weighs no more than a short block's
        row[PATH + WORDS :] = (
            np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(1.0, linked / len(text)), k / n,
            text[-1] in ".!?…", min(1.0, text.count(",") / 5), len(path) / 10, 1 / n,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = PATH + WORDS + EXTRA, HIDDEN_SIZE
        self.w = {}
        for side in "fb":
            self.w[side + "x"] = (r.standard_normal((d, 4 * h)) * 0.08).astype(np.float32)
            self.w[side + "h"] = (r.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # keep what was read, at first
            self.w[side + "b"] = bias
        self.w["o"] = (r.standard_normal(2 * h) * 0.2).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _sweep(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """x: (time, pages, features). Past a page's end its state stays."""
        h = HIDDEN_SIZE
        gates_x = x @ self.w[side + "x"] + self.w[side + "b"]
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        outs, saved = np.zeros((*x.shape[:2], h), np.float32), []
        order = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            g = gates_x[t] + state @ self.w[side + "h"]
            i, f, o, u = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * u
            squashed = np.tanh(new)
            if keep:
                saved.append((t, state, cell, i, f, o, u, squashed, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * squashed) + (1 - m) * state
            outs[t] = state
        return outs, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self._sweep(x, mask, "f", keep)
        b, sb = self._sweep(x, mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return _sigmoid(both @ self.w["o"] + self.w["c"]), both, sf, sb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, sf, sb = self.forward(x, mask, True)
        error = (p - y) * mask / mask.sum()
        grads = {"o": (both * error[:, :, None]).sum((0, 1)), "c": np.array([error.sum()], np.float32)}
        into = error[:, :, None] * self.w["o"]
        h = HIDDEN_SIZE
        for side, saved, d_out in (("f", sf, into[:, :, :h]), ("b", sb, into[:, :, h:])):
            d_gates = np.zeros((*x.shape[:2], 4 * h), np.float32)
            d_state, d_cell, d_h = np.zeros(x.shape[1:2] + (h,), np.float32), np.zeros(x.shape[1:2] + (h,), np.float32), np.zeros_like(self.w[side + "h"])
            for t, state, cell, i, f, o, u, squashed, m in reversed(saved):
                d_state = d_state + d_out[t]
                d_new = (d_cell + d_state * o * (1 - squashed**2)) * m
                g = np.concatenate([d_new * u * i * (1 - i), d_new * cell * f * (1 - f), d_state * m * squashed * o * (1 - o), d_new * i * (1 - u**2)], 1)
                d_gates[t] = g
                d_h += state.T @ g
                d_state = g @ self.w[side + "h"].T + (1 - m) * d_state
                d_cell = d_new * f + (1 - m) * d_cell
            flat = d_gates.reshape(-1, 4 * h)
            grads |= {side + "x": x.reshape(-1, x.shape[2]).T @ flat, side + "h": d_h, side + "b": flat.sum(0)}
        return grads

    def probabilities(self, pages: list[np.ndarray], together: int = 64) -> list[np.ndarray]:
        """For each page's vectors the blocks' probabilities; pages of like length go through together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            some = order[at : at + together]
            while len(some) > 1 and len(some) * len(pages[some[-1]]) > 16384:  # bounded memory
                some = some[: len(some) // 2]
            x, mask = padded([pages[k] for k in some])
            p = self.forward(x, mask)[0]
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
            at += len(some)
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        cut = [blocks(p) for p in pages]
        found = self.probabilities([vectors(c) for c in cut])
        return ["\n".join(b[0] for b, p in zip(c, ps.tolist()) if p > 0.5) for c, ps in zip(cut, found)]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32), np.zeros((longest, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


# ---- made-up pages ---------------------------------------------------------------------------------------------------

#: Names that sites give to their parts.
PLACES = {
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs topnav tabs toolbar".split(),
    "header": "header masthead site-header top branding".split(),
    "footer": "footer site-footer colophon bottom copyright legal".split(),
    "sidebar": "sidebar aside side widget related popular archive tags".split(),
    "notice": "notice cookie cookies consent banner alert popup modal gdpr".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "form": "form newsletter subscribe signup search login contact".split(),
    "comments": "comments comment responses replies discussion disqus reader-comments".split(),
    "share": "share social sharing follow".split(),
    "content": "content main article post entry post-content article-body story body text".split(),
}
PHRASES = {
    "footer": ["© {w}", "Copyright {w} {w}", "All rights reserved.", "Privacy policy", "Terms of use", "Imprint"],
    "notice": ["This site uses cookies. {s}", "Accept", "We value your privacy. {s}", "{s}"],
    "form": ["Search", "Subscribe", "Your e-mail", "Send", "Log in", "Password", "{s}"],
    "share": ["Share", "Tweet", "Follow us", "E-mail this"],
    "comments": ["{w} says:", "Reply", "{s}", "{s} {s}", "{s}", "Leave a comment", "3 comments"],
    "advert": ["Advertisement", "{s}", "Buy {w} now", "{s} {s}"],
    "sidebar": ["Related", "{w} {w} {w}", "{s}", "Most read", "{w}"],
    "header": ["{w} {w}", "{s}", "{w}"],
}


#: Frequent words of four languages: prose is full of them, so they tell nothing about a block.
COMMON = (
    "the of and a to in is it that for with on by this as are was be at or from an not have you all may any new one our we they "
    "has had his her she he will would can more than been were which who when what about into over after before there their "
    "year day time people city work old first last two three said says like use see get make out up so no yes "
    "der die das und ist von zu mit den ein eine im auf für nicht sich des dem wird auch nach bei aus wie "
    "le la les des et est une dans pour que qui sur pas avec ce il elle au plus par son sont "
    "el los las y es una en por que con para se del su como más pero fue"
).split()
#: Parts that only their first words tell from an article, where names and tags do not.
TELLING = {
    "footer": ["© {w} {w}", "Copyright {w}. All rights reserved.", "Imprint", "Terms of use"],
    "notice": ["This site uses cookies. {s}", "We value your privacy. {s}", "We use cookies to {w} {w}."],
    "advert": ["Advertisement", "Sponsored", "Buy {w} now"],
    "comments": ["3 comments", "Comments", "Leave a comment", "{w} says:"],
    "sidebar": ["Related", "Most read", "Popular posts", "Archive"],
    "share": ["Share this", "Follow us", "Share"],
    "form": ["Subscribe", "Your e-mail", "Search", "Sign up for our newsletter"],
    "header": ["{w}"],
}


def sample_page(r: random.Random) -> tuple[str, list[bool]]:
    """A made-up page and, for each of its leaf blocks, whether it is main text."""
    syllables = ["".join(r.choice("bcdfghlmnprstvzéèüöäñ") if c == "c" else r.choice("aeiouéáö") for c in r.choice(["cv", "cvc", "vc", "ccv"])) for _ in range(40)]
    labels: list[bool] = []
    style = r.choice(["telling", "opaque", "bare"])
    # some articles are noise: words said over and over, in capitals, with marks at their ends
    noise = r.random() < 0.12
    usual = r.choice([0, 0.2, 0.4, 0.6])
    marks = "".join(r.choice("!%|*#$&~^+=") for _ in range(r.randint(0, 3))).replace("&", "&amp;")
    spaced, shout, often = r.random() < 0.3, r.random() < 0.5, r.choice([1, 1, 30])

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3])))

    def said() -> str:
        return r.choice(COMMON) if r.random() < usual else word()

    def sentence() -> str:
        words = [said() + ("," if r.random() < 0.1 else "") for _ in range(r.choice([1, 2, 4, 8, 12, 20]))]
        if r.random() < 0.15:
            k = r.randrange(len(words))
            words[k] = f'<a href="/{words[k]}">{words[k]}</a>'
        return " ".join(words).capitalize() + r.choice([".", ".", ".", ".", "?", "!", ":"])

    def prose() -> str:
        if noise:
            some = [word() for _ in range(r.randint(1, 40))]
            return " ".join((w.upper() if shout else w) + (" " if spaced else "") + marks for w in some for _ in range(r.randint(1, often)))
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6, 10])))

    def plain(text: str) -> str:
        return re.sub(r"<[^>]*>", "", text)

    def opaque() -> str:
        kinds = [f"c{r.randint(1, 99)}", f"css-{word()}", word(), f"col-{r.randint(1, 12)}", "wrap", "inner", "box", "row", "container", f"{word()}-{word()}-output", "bd", "clearfix", "grid", "section", "block"]
        return f' {r.choice(["class", "class", "class", "id"])}="{r.choice(kinds)}"'

    def named(kind: str, now: str | None = None) -> str:
        now = now or style
        if now == "bare" or r.random() < 0.15:
            return ""
        if now == "opaque":
            return opaque()
        name = r.choice(PLACES[kind])
        return f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", "-" + word(), " " + word()])}"'

    def block(tag: str, inner: str, main: bool, attributes: str = "") -> str:
        labels.append(main)
        inner = r.choice(["{}", "{}", "{}", "<b>{}</b>", "<span>{}</span>", "{}<br>"]).format(inner)
        end = "" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{attributes}>{inner}{end}"

    def items(main: bool, linked: bool, tag: str = "ul") -> str:
        many = r.randint(1, 8)
        if linked and r.random() < 0.2:  # a line of links
            labels.append(main)
            return r.choice([" | ", " ", " · "]).join(f'<a href="/{word()}">{word().capitalize()}</a>' for _ in range(many))
        return f"<{tag}>" + "".join(block("li", f'<a href="/{word()}">{word()}</a>' if linked else sentence(), main) for _ in range(many)) + f"</{tag}>"

    def phrase(kind: str, phrases: dict = PHRASES) -> str:
        return re.sub(r"\{(.)\}", lambda m: said() if m[1] == "w" else plain(sentence()), r.choice(phrases[kind]))

    def part(kind: str, within: bool = False) -> str:
        own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = own if own not in ("div", "section") and r.random() < 0.6 else r.choice(["div", "div", own])
        known = tag not in ("div", "section")
        told = style == "telling" and r.random() < 0.85
        attributes = f' class="{r.choice(PLACES[kind])}"' if told and not known else named(kind, "telling" if told else style)
        if kind == "menu":
            return f"<{tag}{attributes}>{items(False, True)}</{tag}>"
        if kind == "header" and not known and not told:  # nothing else tells a site's name from a heading
            labels.append(False)
            return f'<{tag}{attributes}><a href="/">{word().capitalize()} {word()}</a></{tag}>'
        first = "" if known or told else block(r.choice(["p", "h3", "div", "h4"]), phrase(kind, TELLING), False)
        if not first and r.random() < 0.35:
            labels.append(False)
            return f"<{tag}{attributes}>{phrase(kind)}</{tag}>"
        # where only first words tell, what follows in the middle of an article is short
        many = r.randint(1, 4) if known or told else r.randint(0, 1 if within else 3)
        inner = "".join(
            items(False, r.random() < 0.7) if kind in ("footer", "sidebar") and r.random() < 0.4
            else block(r.choice(["p", "p", "div", "h3", "li" if kind == "comments" else "p"]), phrase(kind), False)
            for _ in range(many)
        )
        return f"<{tag}{attributes}>{first}{inner}</{tag}>"

    def table() -> str:
        rows = "".join("<tr>" + "".join(block(r.choice(["td", "td", "th"]), plain(sentence())[: r.choice([6, 20, 80])] or "x", True) for _ in range(r.randint(1, 4))) + "</tr>" for _ in range(r.randint(1, 5)))
        return rows

    def article() -> str:
        tag = r.choice(["article"] * 6 + ["main", "section"] + ["div"] * 6 + ["td"])
        if tag in ("article", "main"):
            attributes = named("content") if r.random() < 0.3 else ""
        else:
            attributes = named("content")
        out = []
        paragraph = "div" if r.random() < 0.12 else "p"
        if r.random() < 0.9:
            heading = prose() if noise or r.random() < 0.3 else sentence()
            if r.random() < 0.3:
                heading = plain(heading)[: r.randint(20, 80)]
            title = block(r.choice(["h1", "h1", "h2"]), heading or "x", True)
            out.append(r.choice(["<header>{}</header>", "<div>{}</div>"]).format(title) if r.random() < 0.15 else title)
        if r.random() < 0.1:
            out.append(block(r.choice(["p", "div"]), f"By {word().capitalize()} {word().capitalize()}", True))
        for _ in range(r.choice([0, 1, 2, 3, 4, 8, 15])):
            x = r.random()
            if x < 0.76:
                out.append(block(paragraph, prose(), True))
            elif x < 0.82:
                out.append(block(r.choice(["h2", "h3", "h4"]), plain(sentence()), True))
            elif x < 0.86:
                out.append(items(True, False, r.choice(["ul", "ol"])))
            elif x < 0.88:
                caption = block("caption", plain(sentence()), True) if r.random() < 0.4 else ""
                out.append(f"<table{named('content', 'opaque' if style == 'telling' else None)}>{caption}{table()}</table>")
            elif x < 0.93:
                inner = block(r.choice(["blockquote", "pre", "figcaption", "div", "dt", "dd", "p"]), prose(), True)
                out.append(f"<figure><img src=x>{inner}</figure>" if r.random() < 0.3 else inner)
            else:
                out.append(part(r.choice(["advert", "sidebar", "share", "form", "notice"]), True))
        if r.random() < 0.15:
            out.append(part("comments"))
        inner = "".join(out)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner = f"<div{opaque() if style != 'bare' else ''}>{inner}</div>"
        whole = f"<{tag}{attributes}>{inner}</{tag}>"
        if tag == "td":
            at = len(labels)
            side = f"<td>{items(False, True)}</td>" if r.random() < 0.6 else ""
            made = labels[at:]
            del labels[at:]
            first = len(labels) - count_of(whole)
            if side and r.random() < 0.5:
                labels[first:first] = made
                whole = side + whole
            else:
                labels.extend(made)
                whole += side
            whole = f"<table><tr>{whole}</tr></table>"
        return whole

    def count_of(whole: str) -> int:
        return len(blocks(f"<table><tr>{whole}" if whole.startswith("<td") else whole))

    body = [part(k) for k in r.sample(["menu", "header", "notice", "advert", "form", "share"], r.randint(0, 4))]
    if r.random() < 0.25:
        body.append(part("sidebar"))
    if r.random() < 0.97:
        body.append(article())
    body += [part(k) for k in r.sample(["comments", "sidebar", "advert", "share", "form", "notice", "menu"], r.randint(0, 3))]
    if r.random() < 0.85:
        body.append(part("footer"))
    inner = "".join(body)
    for _ in range(r.choice([0, 0, 1, 2])):
        inner = f"<div{opaque()}>{inner}</div>"
    head = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"{head}<body>{inner}" + r.choice(["</body></html>", ""]), labels


def train(pages: int = 4000, rounds: int = 8, batch: int = 32, seed: int = 11, rate: float = 0.015) -> Labeller:
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, labels = sample_page(r)
        cut = blocks(page)
        if cut and len(cut) == len(labels):
            data.append((vectors(cut), np.array(labels, np.float32)))
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for turn in range(rounds):
        order = list(range(len(data)))
        r.shuffle(order)
        order.sort(key=lambda k: len(data[k][1]) // 8)
        batches = [order[a : a + batch] for a in range(0, len(order), batch)]
        r.shuffle(batches)
        for some in batches:
            x, mask = padded([data[k][0] for k in some])
            y = np.zeros_like(mask)
            for j, k in enumerate(some):
                y[: len(data[k][1]), j] = data[k][1]
            step += 1
            for name, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                pace = rate * (1 - turn / (rounds + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                model.w[name] -= (pace * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return model


_TRAINED: list[Labeller] = []


def trained() -> Labeller:
    """The labeller, trained once per process."""
    if not _TRAINED:
        _TRAINED.append(train())
    return _TRAINED[0]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = list(rows_of(batch, "page_id", "url", "html"))
            for at in range(0, len(rows), 128):
                some = rows[at : at + 128]
                texts = own.texts([r[2] for r in some])
                yield record(schema, [[r[0] for r in some], [r[1] for r in some], texts, list(map(len, texts))])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(narrow, "page_id long, url string, text string, n_chars long", label)
