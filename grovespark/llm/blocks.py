"""Main text of web pages: a recurrent labeller over the leaf blocks of the whole page.

A page is parsed into its leaf blocks, each with its path of tags and its words. A bidirectional
LSTM in numpy reads the blocks as one sequence of vectors (hashed tag path, hashed words, a few
measures) and labels every block as main text or not, with the whole page as context. It is
trained here, on pages that this module makes up from a seed.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, table

#: Many more than names that matter, so that a new name seldom falls on one of them.
PATH_DIM = 512
WORD_DIM = 24
MEASURES = 7
INPUT = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 24
TRAIN_PAGES = 3000
EPOCHS = 8
BATCH = 30
RATE = 0.01
SEED = 11
#: Share of the path's measures that training blanks.
MASKED = 0.08
#: Blocks (padding included) that one step of inference holds; a longer page is read in windows of as many.
BATCH_BLOCKS = 1 << 13

#: Steps of a path that count by their distance; farther ones count alike.
NEAR = 8
FADE = 0.8

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_MARKUP = re.compile(r"<[a-zA-Z/!?]")
_NAMED = re.compile(r"(?:\b(class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: What is no text of the page at all; everything else is for the labeller to judge.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style")}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends open tags of the second.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}.items()}
#: Any block closes an open paragraph.
_P = frozenset(("p",))
#: Beyond these a tag closes none.
SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "article", "section", "div", "main", "aside", "nav"))


class Place:
    """Where a block stands: its open tags with their words of class, id and role, the nearest NEAR of them one by one."""

    __slots__ = ("tag", "near", "far", "depth", "_vector", "_inner")

    def __init__(self, tag: str = "", near: tuple[str, ...] = (), far: np.ndarray | None = None, depth: int = 0):
        self.tag, self.near, self.far, self.depth, self._vector, self._inner = tag, near, far, depth, None, None

    def inside(self, tag: str, step: str) -> Place:
        """The place in a further tag, one object for all alike; costs the same at any depth."""
        if self._inner is None:
            self._inner = {}
        if (found := self._inner.get(step)) is None:
            far, near = self.far, (*self.near, step)
            if len(near) > NEAR:
                gone = _step_vector(near[0])
                far, near = gone if far is None else far + gone, near[1:]
            found = self._inner[step] = Place(tag, near, far, self.depth + 1)
        return found

    def vector(self) -> np.ndarray:
        """Signed hashes of the tags and names on the path, nearer ones heavier, and of its last two steps."""
        if self._vector is None:
            near = _near_vector(self.near)
            self._vector = near if self.far is None else near + np.float32(FADE**NEAR) * self.far
        return self._vector


class Block:
    """A leaf: its text, its place, and how much of it is links."""

    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Place, linked: float):
        self.text, self.place, self.linked = text, place, linked


def _step(tag: str, attributes: str) -> str:
    """A step of a path: the tag and the words of its class, id and role."""
    words = [w for m in _NAMED.finditer(attributes) for w in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())]
    return " ".join([tag, *words])


_short_step = functools.lru_cache(maxsize=50_000)(_step)


class _Ends:
    """Where tags end. Whatever the page, all calls together look at each character a few times at most."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()  # stops from which no end was found
        self.first: tuple[int, re.Match | None] = (-1, None)

    def __call__(self, at: int) -> int | None:
        """The place after the > that ends a tag whose name ends at at, one outside quoted values; a quote that is never closed is none."""
        if at > self.last:
            return None
        low, m = self.first
        if not (0 <= low <= at and m is not None and at <= m.start()):
            m = _STOP.search(self.page, at)
            self.first = (at, m)
        seen = []
        while m is not None and m[1] is not None and m.start() not in self.dead:
            seen.append(m.start())
            to = self.page.find(m[1], m.end()) + 1 if self.quotes[m[1]] >= m.end() else m.end()
            m = _STOP.search(self.page, to) if to <= self.last else None
        if m is not None and m[1] is None:
            return m.end()
        self.dead.update(seen)
        return None


def parse(page: str) -> list[Block]:
    """The blocks of a page in order, each non-empty, references decoded and white space made single spaces.

    Only markup, scripts and styles are left out. What is not closed swallows nothing: a < that no >
    follows is text, a comment without end ends with its tag, a script or style without end at the next
    tag. The time is linear in the page, however deep or broken its tags are.
    """
    blocks: list[Block] = []
    top = Place()
    stack: list[Place] = []
    open_: Counter = Counter()  # tags on the stack
    parts: list[str] = []
    links = chars = 0
    link: int | None = None  # depth at which a link is open

    def text(piece: str) -> None:
        nonlocal links, chars
        piece = html.unescape(piece)
        parts.append(piece)
        chars += len(piece)
        links += len(piece) if link is not None else 0

    def flush() -> None:
        nonlocal links, chars
        if parts:
            found = " ".join("".join(parts).split())
            if found:
                blocks.append(Block(found, stack[-1] if stack else top, links / max(1, chars)))
            parts.clear()
        links = chars = 0

    def close(tags: frozenset[str], bounded: bool) -> None:
        """End the innermost open tag of tags and all in it; bounded: not beyond the list, table or section around."""
        nonlocal link
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                open_.subtract(x.tag for x in stack[k:])
                del stack[k:]
                if link is not None and link > k:
                    link = None
                return
            if bounded and stack[k].tag in SCOPE:
                return

    ends, at, size = _Ends(page), 0, len(page)
    endless: set[str] = set()  # comments, scripts or styles that have no end any more
    while at < size:
        if page[at] != "<":
            to = page.find("<", at)
            to = size if to < 0 else to
            text(page[at:to])
            at = to
            continue
        if page[at + 1 : at + 2] in ("!", "?") and at < ends.last:
            end = page.find("-->", at + 2) if page.startswith("<!--", at) and "!" not in endless else -1
            if end < 0:
                if page.startswith("<!--", at):
                    endless.add("!")
                at = page.find(">", at) + 1
            else:
                at = end + 3
            continue
        m = _TAG.match(page, at)
        end = ends(m.end()) if m else None
        if end is None:
            text("<")
            at += 1
            continue
        ending, tag, attributes = m[1], m[2].lower(), page[m.end() : end - 1]
        at = end
        if tag in RAW:
            shut = RAW[tag].search(page, at) if not ending and tag not in endless else None
            if shut and shut.end() <= ends.last:
                at = page.find(">", shut.end()) + 1
            elif not ending:
                endless.add(tag)
                more = _MARKUP.search(page, at)
                at = more.start() if more else size
            continue
        if tag in INLINE:
            if tag == "a":
                link = None if ending else len(stack)
            continue
        flush()
        if ending:
            close(frozenset((tag,)), False)
            continue
        if tag != "br" and stack and stack[-1].tag == "p":
            close(_P, False)
        if tag in CLOSES:
            close(CLOSES[tag], True)
        if tag not in VOID:
            step = _short_step(tag, attributes) if len(attributes) < 200 else _step(tag, attributes)
            stack.append((stack[-1] if stack else top).inside(tag, step))
            open_[tag] += 1
    flush()
    return blocks


def _add(out: np.ndarray, step: str, weight: float) -> None:
    for name in step.split():
        h = zlib.crc32(name.encode("utf-8", "replace"))
        out[h % PATH_DIM] += (1 if h >> 16 & 1 else -1) * weight


@functools.lru_cache(maxsize=20_000)
def _step_vector(step: str) -> np.ndarray:
    out = np.zeros(PATH_DIM, dtype=np.float32)
    _add(out, step, 1.0)
    return out


@functools.lru_cache(maxsize=100_000)
def _near_vector(near: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIM, dtype=np.float32)
    for depth, step in enumerate(reversed(near)):
        _add(out, step, FADE**depth)
    _add(out, "/".join(x.split(" ", 1)[0] for x in near[-2:]), 1.0)
    return out


class _Slots(dict):
    """Slot of each word: below WORD_DIM it counts up, above it counts down."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = zlib.crc32(word.encode("utf-8", "replace"))
        self[word] = out = h % WORD_DIM + (0 if h >> 16 & 1 else WORD_DIM)
        return out


_slots = _Slots()


def vectors(blocks: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """The input sequence of a page, or of its blocks from first to last: one row per block."""
    n = len(blocks)
    blocks = blocks[first:last]
    out = np.zeros((len(blocks), INPUT), dtype=np.float32)
    for i, b in enumerate(blocks):
        words = b.text.split()
        counts = np.bincount([_slots[w] for w in words], minlength=2 * WORD_DIM)
        signed = counts[:WORD_DIM] - counts[WORD_DIM:]
        length = len(b.text)
        out[i, :PATH_DIM] = b.place.vector()
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = signed / (np.sqrt((signed**2).sum()) + 1)
        out[i, PATH_DIM + WORD_DIM :] = (1.0, np.log1p(length) / 8, min(len(words), 40) / 40, b.linked, (first + i) / n, min(b.place.depth, 32) / 8, (b.text[-1] in ".!?:;\"'") * 1.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 1 / np.sqrt(INPUT + HIDDEN), (INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + d] = np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), HIDDEN)
        self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["s"] = rng.normal(0, 0.05, INPUT).astype(np.float32)
        self.p["t"] = np.zeros(1, dtype=np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None, state: list | None = None) -> np.ndarray:
        """Hidden states (pages, blocks, HIDDEN) in one direction; padding keeps the state as it was. A given state is where it starts, and is left where it ends."""
        pages, steps, _ = x.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((pages, steps, HIDDEN), np.float32)
        ahead = x @ self.p["W" + d][:INPUT] + self.p["c" + d]
        inner = self.p["W" + d][INPUT:]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = ahead[:, t] + h @ inner
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t : t + 1]
            new = f * c + i * g
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, new, m))
            h, c = m * (o * np.tanh(new)) + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def margins(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, None) for d in "fb"], axis=2)
        return both @ self.p["o"] + x @ self.p["s"] + self.p["t"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes = {"f": [], "b": []}
        states = {d: self._pass(x, mask, d, tapes[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        delta = (_sigmoid(both @ self.p["o"] + x @ self.p["s"] + self.p["t"]) - y) * mask / mask.sum()
        grads = {"o": delta.reshape(-1) @ both.reshape(-1, 2 * HIDDEN), "s": delta.reshape(-1) @ x.reshape(-1, INPUT), "t": np.array([delta.sum()])}
        for k, d in enumerate("fb"):
            outer = delta[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            W = self.p["W" + d]
            inner, dh, dc = W[INPUT:].T.copy(), np.zeros_like(outer[:, 0]), np.zeros_like(outer[:, 0])
            zs, before = np.empty((*x.shape[:2], 4 * HIDDEN), outer.dtype), np.empty_like(states[d])
            for t, h, c, i, f, o, g, new, m in reversed(tapes[d]):
                dh = dh + outer[:, t]
                squashed = np.tanh(new)
                down, dn = m * dh, m * (dh * o * (1 - squashed**2) + dc)
                zs[:, t] = z = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), down * squashed * o * (1 - o), dn * i * (1 - g**2)], axis=1)
                before[:, t] = h
                dh, dc = (1 - m) * dh + z @ inner, (1 - m) * dc + dn * f
            flat = zs.reshape(-1, 4 * HIDDEN)
            gW, gc = np.concatenate([x.reshape(-1, INPUT).T @ flat, before.reshape(-1, HIDDEN).T @ flat]), flat.sum(axis=0)
            grads["W" + d], grads["c" + d] = gW, gc
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Labeller:
        """Adam over batches of pages of like length, at a rate that falls to none."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        for epoch in range(epochs):
            starts, now = np.arange(0, len(order), BATCH), rate * (1 - epoch / epochs)
            rng.shuffle(starts)
            for at in starts:
                x, mask, y = padded([pages[k] for k in order[at : at + BATCH]])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g**2
                    self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text; pages of like length go together, long ones in windows."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, at = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])), 0
        while at < len(order):
            if len(pages[order[at]]) > BATCH_BLOCKS:
                out[order[at]] = self._in_windows(pages[order[at]]) > 0
                at += 1
                continue
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= BATCH_BLOCKS:
                to += 1
            x, mask, _ = padded([(vectors(pages[k]), np.zeros(len(pages[k]))) for k in order[at:to]])
            for k, row in zip(order[at:to], self.margins(x, mask) > 0):
                out[k] = row[: len(pages[k])]
            at = to
        return out

    def _in_windows(self, blocks: list[Block]) -> np.ndarray:
        """The margins of one page: each direction reads it window by window and carries its state on, so memory does not grow with the page's vectors."""
        out = np.full(len(blocks), self.p["t"][0], np.float32)
        starts = range(0, len(blocks), BATCH_BLOCKS)
        for k, d in enumerate("fb"):
            state = [np.zeros((1, HIDDEN), np.float32)] * 2
            for at in starts if d == "f" else reversed(starts):
                x = vectors(blocks, at, at + BATCH_BLOCKS)
                hidden = self._pass(x[None], np.ones((1, len(x)), np.float32), d, None, state)[0]
                out[at : at + len(x)] += hidden @ self.p["o"][k * HIDDEN : (k + 1) * HIDDEN] + (x @ self.p["s"] if d == "f" else 0)
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(len(y) for _, y in pages)
    x, mask, y = np.zeros((len(pages), n, INPUT), np.float32), np.zeros((len(pages), n), np.float32), np.zeros((len(pages), n), np.float32)
    for k, (vec, lab) in enumerate(pages):
        x[k, : len(lab)], mask[k, : len(lab)], y[k, : len(lab)] = vec, 1, lab
    return x, mask, y


#: Stands before each block of main text while a page is made up.
_MARK = "\ue000"


def _marked_page(rng: np.random.Generator) -> str:
    """A page from a random layout, _MARK before each block of its main text.

    What holds the main text says little: it may be any tag, with made-up names, usual ones or none,
    nested or missing, and what surrounds it stands in the same tags. Names tell adverts and comments
    apart, which read like prose; menus, footers and forms often have none.
    """
    draw = random.Random(int(rng.integers(1 << 62)))
    pick = lambda *x: draw.choice(x)
    syllables = "ta re mi so lu ne ka do vi pe an er on st th in es ou".split()
    word = lambda: "".join(draw.choices(syllables, k=draw.randrange(1, 5)))
    many = lambda low, high: range(draw.randrange(low, high))
    noise = pick("", "", "", "", "***", "!!", "###", " |")

    def sentence(low: int, high: int, noise: str = "") -> str:
        out = " ".join(word() + noise for _ in many(low, high))
        return (out.upper() if noise == "!!" else out.capitalize()) + pick(".", ".", ".", "", "!")

    def named(tag: str, *usual: str, sure: bool = False) -> str:
        """An opening tag with one of the usual names, a made-up one, or none; sure: one of the usual names."""
        kind = draw.random()
        name = pick(*usual) if usual and (sure or kind < 0.3) else f"{word()}{pick('', '-', '_')}{word()}" if kind < 0.65 else ""
        return f"<{tag} {pick('class', 'class', 'id')}={pick(chr(34) + name + chr(34), name.split()[0])}>" if name else f"<{tag}>"

    def box(tags: str, inside: str, *usual: str, sure: bool = False) -> str:
        tag = pick(*tags.split())
        return f"{named(tag, *usual, sure=sure)}{inside}</{tag}>"

    def keep(text: str, tag: str) -> str:
        inside = _MARK + html.escape(text, quote=False)
        if draw.random() < 0.2:
            first, _, rest = inside.partition(" ")
            mark = pick("b", "em", "span", "strong", "a href=/x")
            inside = f"<{mark}>{first}</{mark.split()[0]}> {rest}" if draw.random() < 0.7 else f"<b>{first} {rest}"
        return f"<{tag}>{inside}" + ("" if tag == "p" and draw.random() < 0.2 else f"</{tag.split()[0]}>")

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{word()}">{pick(word(), sentence(1, 4))}</a></li>' for _ in many(low, high))

    def menu() -> str:
        inside = pick(f"<ul>{links(2, 12)}</ul>", "".join(f'<a href="/{word()}">{word()}</a>{pick(" ", " | ", "<br>")}' for _ in many(2, 9)))
        return pick(f"<nav>{inside}</nav>", f"<header><nav>{inside}</nav></header>", box("div section ul header", inside, "menu", "navigation", "nav", "top nav", "breadcrumb"))

    def advert() -> str:
        inside = sentence(3, 40)
        return box("div section aside", pick(inside, f"<p>{inside}</p>"), "ad", "ad", "ads", "advert banner", "advertisement", "sponsored", "promo", sure=True)

    def aside() -> str:
        heading = pick("h2", "h3", "h4")
        inside = f"<{heading}>{sentence(1, 4)}</{heading}><ul>{links(2, 7)}</ul>"
        return pick(f"<aside>{inside}</aside>", box("div section", inside, "sidebar", "related", "popular", "more"))

    def form() -> str:
        fields = pick("<p>{}</p><button>{}</button>", "<label>{}</label><input name=e><button>{}</button>", "<label>{}</label><select><option>{}</option></select>", "<label>{}</label><textarea>{}</textarea><button>OK</button>", "<textarea>{}</textarea><button>{}</button>")
        return f"{named('form', 'contact', 'search', 'newsletter')}{fields.format(sentence(2, 20), word())}</form>"

    def notice() -> str:
        inside = pick("<p>{}</p><button>{}</button>", '<p>{}</p><a href="#">{}</a>', "{} <button>{}</button>").format(sentence(4, 25), word())
        return pick(box("div section", inside, "cookie", "cookies consent", "notice", "newsletter", sure=True), f"<noscript><p>{sentence(2, 15)}</p><img src=x></noscript>", f"<template><div>{sentence(2, 9)}</div></template>")

    def share() -> str:
        return box("div ul p", f'<svg><title>{word()}</title></svg><a href="#">{word()}</a> <a href="#">{word()}</a>', "share", "social", "tools")

    def comments() -> str:
        one = pick("<li><b>{}</b><p>{}</p></li>", '<div class="comment"><span>{}</span><p>{}</p></div>', '<article class="comment"><h4>{}</h4><p>{}</p></article>', "<p>{}: {}</p>")
        heading = pick("", "<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>").format(pick("Comments", f"{draw.randrange(2, 90)} comments", "Discussion", sentence(1, 4)))
        inside = heading + "".join(one.format(word(), sentence(5, 60)) for _ in many(1, 6))
        return box("section div ol", inside, "comments", "comments", "comment-list", "discussion comments", "responses comments", "reader comments", sure=True)

    def body() -> str:
        paragraph = pick("p", "p", "p", "p", "p", "div", "br", named("div", "para", "text")[1:-1])
        out = [keep(sentence(1, 9, noise), pick("h1", "h1", "h2"))] if draw.random() < 0.85 else []
        for _ in many(1, 16):
            kind = draw.random()
            if kind < 0.75:
                text = sentence(1, pick(4, 20, 150), noise)
                out.append(f"{_MARK}{html.escape(text, quote=False)}<br><br>" if paragraph == "br" else keep(text, paragraph if draw.random() < 0.9 else pick("pre", "dd", "p")))
            elif kind < 0.8:
                out.append(keep(sentence(1, 6, noise), pick("h2", "h3")))
            elif kind < 0.84:
                out.append(f"<blockquote>{keep(sentence(4, 40, noise), 'p')}</blockquote>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(keep(sentence(1, 12, noise), "li") for _ in many(1, 5)) + "</ul>")
            elif kind < 0.9:
                cells = "".join("<tr>" + "".join(keep(sentence(1, 7, noise), pick("td", "td", "th")) for _ in range(2)) + "</tr>" for _ in many(1, 4))
                out.append(f"<table>{cells}</table>")
            elif kind < 0.92:
                out.append(f"<figure><img src=x>{keep(sentence(2, 12, noise), 'figcaption')}</figure>")
            elif kind < 0.95:
                out.append(f"<p><b>{_MARK}{html.escape(sentence(2, 20, noise), quote=False)}<br><p>{_MARK}{html.escape(sentence(2, 20, noise), quote=False)}</p>")
            else:
                out.append(pick(advert, aside, notice, share)())
        if draw.random() < 0.3:
            out.append(comments())
        inside = "".join(out)
        for _ in range(pick(0, 1, 1, 1, 2, 3)):
            tag = pick("article", "article", "main", "div", "div", "div", "section", "section", "td", f"{word()}-{word()}")
            whole = named(tag, "content", "main", "post", "entry", "story", "article-body", "text", "page") + inside + f"</{tag}>"
            inside = f"<table><tr>{whole}</tr></table>" if tag == "td" else whole
        return inside

    title = html.escape(sentence(1, 9, noise), quote=False)
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>'
    before = [f() for f in (menu, advert, notice, aside, form) if draw.random() < 0.5]
    if draw.random() < 0.3:
        before.append(pick("<header>{}</header>", "<header>{}</header>", box("div section", "{}", "header", "masthead", "top", sure=True)).format(f'<a href="/">{word()}</a><p>{sentence(1, 6)}</p>'))
    draw.shuffle(before)
    after = [f() for f in (share, comments, aside, advert, notice, form) if draw.random() < 0.4]
    line = f"&copy; {word()}{pick('.example', '')} &middot; {sentence(1, 20)}"
    foot = pick(f"<footer>{line}</footer>", f"<footer><p>{line}</p></footer>", box("div section p", line, "footer", "bottom", "legal"), box("div", f"<p>{line}</p><p>{sentence(1, 9)}</p>", "footer", sure=True), "")
    inside = body()
    page = "".join(before) + inside + "".join(after) + foot
    for _ in range(pick(0, 0, 1, 1, 2)):
        page = box("div div section", page, "wrapper", "page", "container", "site")
    return head + page + "</body></html>"


def made_up_page(rng: np.random.Generator) -> tuple[str, str]:
    """A page from a random layout and its main text."""
    page = _marked_page(rng)
    return page.replace(_MARK, ""), " ".join(b.text.removeprefix(_MARK) for b in parse(page) if b.text.startswith(_MARK))


def training_page(rng: np.random.Generator, masked: float = MASKED) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a made-up page and which of them are its main text; a share of the path's measures, drawn for each page, is blank."""
    blocks = parse(_marked_page(rng))
    labels = np.array([b.text.startswith(_MARK) for b in blocks], dtype=np.float32)
    for b in blocks:
        b.text = b.text.removeprefix(_MARK) or "."
    out = vectors(blocks)
    out[:, :PATH_DIM] *= rng.random(PATH_DIM) >= masked
    return out, labels


@functools.lru_cache(maxsize=2)
def trained(seed: int = SEED, pages: int = TRAIN_PAGES) -> Labeller:
    rng = np.random.default_rng(seed)
    return Labeller(seed).fit([training_page(rng) for _ in range(pages)], seed=seed)


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    parsed = [parse(x or "") for x in pages]
    return [" ".join(b.text for b, k in zip(blocks, keep) if k) for blocks, keep in zip(parsed, labeller.label(parsed))]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text) of each row of pages (page_id, url, html). A null or empty html, or one without main text, gives an empty text."""
    spark = pages.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(labeller or trained())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column("html").to_pylist(), []
            for at in range(0, len(rows), 200):
                texts += main_texts(rows[at : at + 200], model.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
