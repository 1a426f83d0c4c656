"""Main text of web pages by composite text density.

A page becomes a tree. Every node gets its number of characters per tag, adjusted by how much of the text is
link text. The node whose children have the greatest sum of densities is the core of the article. The least
density on the path from the body to the core is the threshold that text beside the core must reach. An article or main
element on that path stands for the core if its density reaches the body's; a sparser one is passed over.

Parts that by element or class are no article (menus, footers, adverts, forms, comments) count and give nothing, unless
they wrap the article: a part with the page's article, main or first heading in it, or with nearly all of its text, stays.
Scripts, styles and the like never give text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

_TAG = re.compile(r"<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|(?P<note>!--)|[!?/][^>]*>)")
_MARK = re.compile("[>\"']")
_KIND = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCKS = frozenset(
    "html body p div article section main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre header footer aside nav form fieldset figure figcaption hr address details summary".split()
)
#: Elements inside which an end tag or an implied end is not searched any further.
SCOPES = frozenset("html body div article section main table td th ul ol dl blockquote aside nav form header footer".split())
#: Elements whose ids are about their text.
ABOUT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements whose text is never read.
NO_TEXT = frozenset("head script style textarea title noscript iframe template svg canvas object select".split())
#: Elements that are no part of an article unless they wrap it.
BESIDE = frozenset("nav footer aside form button menu dialog".split())
#: Parts of names in class, id or role that mark such parts.
KINDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments disqus reply replies discussion share sharing social related recommended widget toolbar "
    "pagination pager login search copyright contentinfo complementary".split()
)
#: Parts of names that may stand beside those; a name with any other part marks nothing.
BESIDE_KINDS = frozenset(
    "list box bar block area wrap wrapper container section slot unit left right top bottom site page global main links link buttons button "
    "posts articles items item form inner outer content panel region group row col column thread text message holder module header bg".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P = frozenset({"p"})
_SPACE = " "
#: A part stays if it has over half of a page's text, and the text outside of all such parts is less than this share of its own.
LITTLE = 0.1


@lru_cache(maxsize=4096)
def marks(name: str, attrs: str, inside: bool) -> bool:
    """Whether names in class, id or role say that an element is no part of an article.

    Each name must consist of known parts and hold one that marks. The ids of headings and paragraphs, and all ids
    inside an article, name what they are about and are not read.
    """
    for what, value in _KIND.findall(attrs):
        if what.lower() == "id" and (inside or name in ABOUT):
            continue
        for word in value.strip("\"'").split():
            parts = {p.lower() for p in _PART.findall(word)}
            if parts & KINDS and all(p in KINDS or p in BESIDE_KINDS or p.isdigit() for p in parts):
                return True
            if not inside and parts and parts <= {"header", "site", "page", "top", "main", "global"} and "header" in parts:
                return True
    return False


class _Closes:
    """Where tags end: the first > outside of quotes after a place, or the first at all if quotes are not closed.

    Marks are read once from the end of the page, so that a page of any quotes takes linear time.
    """

    def __init__(self, source: str):
        self.places = [m.start() for m in _MARK.finditer(source)]
        self.plain = [0] * len(self.places)
        self.outside: list[int | None] = [None] * (len(self.places) + 1)
        last, close = {}, -1  # the next place of each quote in self.places, and of any >
        for k in range(len(self.places) - 1, -1, -1):
            mark = source[self.places[k]]
            if mark == ">":
                close = self.outside[k] = self.places[k]
            else:
                if mark in last:
                    self.outside[k] = self.outside[last[mark] + 1]
                last[mark] = k
            self.plain[k] = close

    def after(self, place: int) -> int:
        k = bisect_left(self.places, place)
        if k == len(self.places):
            return -1
        return self.plain[k] if self.outside[k] is None else self.outside[k]


class _Page:
    """Nodes in the order of their start tags, as parallel lists; text pieces with None for a border of blocks.

    hidden nodes are never read; beside nodes are marked as no part of an article. Where an element is open is known
    by its name, so a tag takes the same time however many are open.
    """

    def __init__(self, source: str):
        self.names, self.parents, self.hidden, self.beside = ["#page"], [-1], [False], [False]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.first, self.last = [0], [0]
        self.pieces: list[str | None] = []
        self.open = [0]
        self.depths: dict[str, list[int]] = {}  # of the open elements of a name
        self._read(source)
        while self.open:
            self._pop()
        self.own_chars = self.chars[:]
        self.own_links = self.link_chars[:]
        for k in range(len(self.names) - 1, 0, -1):
            p = self.parents[k]
            self.chars[p] += self.chars[k]
            self.tags[p] += self.tags[k] + 1
            self.link_chars[p] += self.link_chars[k]
            self.link_tags[p] += self.link_tags[k] + (self.names[k] == "a")

    def _read(self, source: str) -> None:
        place, n = 0, len(source)
        last_end = source.rfind(">")
        closes = None
        while place < n:
            at = source.find("<", place)
            if at < 0 or at > last_end:
                self._text(source[place:])
                return
            if at > place:
                self._text(source[place:at])
            found = _TAG.match(source, at)
            if found is None:
                self._text("<")
                place = at + 1
                continue
            place = found.end()
            if found["note"]:
                stop = source.find("-->", place)
                place = n if stop < 0 else stop + 3
            elif found["name"]:
                name = found["name"].lower()
                stop = source.find(">", place)
                quoted = stop < 0 or source.find('"', place, stop) >= 0 or source.find("'", place, stop) >= 0
                if quoted and stop >= 0:
                    closes = closes or _Closes(source)
                    stop = closes.after(place)
                if stop < 0:
                    self._text("<")
                    place = at + 1
                    continue
                attrs, place = source[place:stop], stop + 1
                if found["end"]:
                    self._end(name)
                else:
                    self._start(name, attrs)
                    if name in RAW:
                        stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, place)
                        place = stop.start() if stop else n

    def _is_open(self, name: str) -> bool:
        return bool(self.depths.get(name))

    def _text(self, text: str) -> None:
        node = self.open[-1]
        if self.hidden[node]:
            return
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append(text)
        size = len(text.strip())
        self.chars[node] += size
        if size and self._is_open("a"):
            self.link_chars[node] += size

    def _innermost(self, names) -> int:
        """The depth of the innermost open element of these names; 0 if there is none."""
        most = 0
        for name in names:
            depths = self.depths.get(name)
            if depths and depths[-1] > most:
                most = depths[-1]
        return most

    def _close_to(self, names: set | frozenset, scopes: frozenset) -> None:
        depth = self._innermost(names)
        if depth and depth >= self._innermost(scopes):
            while len(self.open) > depth:
                self._pop()

    def _pop(self) -> None:
        node = self.open.pop()
        name = self.names[node]
        if node:
            self.depths[name].pop()
        if name in BLOCKS:
            self.pieces.append(None)
        self.last[node] = len(self.pieces)

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCKS and self._is_open("p"):
            self._close_to(_P, SCOPES)
        if name in _ENDS:
            self._close_to(_ENDS[name], SCOPES - _ENDS[name])
        parent = self.open[-1]
        if name in VOID:
            self.tags[parent] += 1
            if not self.hidden[parent]:
                self.pieces.append(None if name in BLOCKS else _SPACE if name == "br" else "")
            return
        beside = False
        if name not in ("html", "body", "article", "main"):
            inside = self._is_open("article") or self._is_open("main")
            beside = name in BESIDE or name == "header" and not inside or bool(attrs) and marks(name, attrs, inside)
        if name in BLOCKS:
            self.pieces.append(None)
        self.names.append(name)
        self.parents.append(parent)
        self.hidden.append(self.hidden[parent] or name in NO_TEXT)
        self.beside.append(beside)
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags, self.last):
            counts.append(0)
        self.first.append(len(self.pieces))
        self.depths.setdefault(name, []).append(len(self.open))
        self.open.append(len(self.names) - 1)

    def _end(self, name: str) -> None:
        if name not in VOID:
            self._close_to({name}, frozenset() if name in SCOPES else SCOPES)

    def _dead(self) -> list[bool]:
        """Whether each node gives nothing: hidden ones, and what lies in a part beside the article."""
        names, parents, n = self.names, self.parents, len(self.names)
        holds = [name in ("article", "main") for name in names]  # nodes with an article, or where there is none a first heading, inside
        if not any(holds):
            holds = [name == "h1" for name in names]
        for k in range(n - 1, 0, -1):
            holds[parents[k]] = holds[parents[k]] or holds[k]
        outside = [False] * n
        for k in range(1, n):
            outside[k] = outside[parents[k]] or self.beside[k] and not holds[k]
        plain = [c - a for c, a in zip(self.own_chars, self.own_links)]
        rest = sum(c for c, x in zip(plain, outside) if not x)
        most = max(rest / LITTLE, sum(plain) / 2)
        dead = self.hidden[:]
        for k in range(1, n):
            if not dead[k]:
                wraps = holds[k] or self.chars[k] - self.link_chars[k] > most
                dead[k] = dead[parents[k]] or self.beside[k] and not wraps
        return dead

    def density(self, node: int, link_share: float) -> float:
        """Characters per tag, raised to how much there is of text and tags beside links."""
        c, t = self.chars[node], max(self.tags[node], 1)
        if not c:
            return 0.0
        lc, lt = self.link_chars[node], max(self.link_tags[node], 1)
        base = math.log(c / max(c - lc, 1) * lc + link_share * c + math.e)
        return c / t * max(math.log(c / max(lc, 1) * t / lt), 0.0) / math.log(base) if base > 1.0001 else c / t * max(math.log(c / max(lc, 1) * t / lt), 0.0)

    def text_of(self, nodes: list[int], dead: list[bool]) -> str:
        """Blocks of the nodes, which lie apart and in page order, without their dead parts."""
        blocks, parts = [], []
        tops = iter([k for k in range(1, len(dead)) if dead[k] and not dead[self.parents[k]]])
        skip = next(tops, None)
        for node in nodes:
            place, stop = self.first[node], self.last[node]
            while place < stop or parts:
                while skip is not None and (self.last[skip] <= place or skip < node):
                    skip = next(tops, None)
                piece = None
                if place < stop and skip is not None and self.first[skip] <= place:
                    place = self.last[skip]
                    piece = "" if self.names[skip] not in BLOCKS else None
                elif place < stop:
                    piece = self.pieces[place]
                    place += 1
                if piece is not None:
                    parts.append(piece)
                elif parts:
                    block = " ".join("".join(parts).split())
                    if block:
                        blocks.append(block)
                    parts = []
        return "\n".join(blocks)

    def main_text(self) -> str:
        names, parents = self.names, self.parents
        dead = self._dead()
        live = [k for k in range(len(names)) if not dead[k]]
        body = next((k for k in live if names[k] == "body"), 0)
        link_share = self.link_chars[body] / max(self.chars[body], 1)
        density = {k: self.density(k, link_share) for k in live}
        sums = dict.fromkeys(live, 0.0)
        for k in live:
            if parents[k] in sums and names[k] in BLOCKS:
                sums[parents[k]] += density[k]
        inside = [k for k in live if k >= body and self.last[k] <= self.last[body] and self.first[k] >= self.first[body]]
        core = max(inside, key=lambda k: (sums[k], density[k], -k))
        path = [core]
        while path[-1] != body and parents[path[-1]] >= 0:
            path.append(parents[path[-1]])
        threshold = min(density[k] for k in path)
        # an article or main element stands for the core if its text is at least as dense as the body's
        whole = [k for k in path if names[k] in ("article", "main") and density[k] >= density[body]]
        if whole or core == body:
            return self.text_of([whole[-1] if whole else body], dead)
        on_path, chosen = set(path), [core]
        for k in inside:
            if parents[k] in on_path and parents[k] != core and k not in on_path and density[k] >= threshold and names[k] in BLOCKS:
                chosen.append(k)
        return self.text_of(sorted(chosen), dead)


def main_text(source: str) -> str:
    """The article's blocks, white space inside a block as one space, joined by line breaks."""
    return _Page(source).main_text() if source.strip() else ""


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages and pages without text have empty text. Broken markup is read as far as it goes: ends
    that are missing are implied, a `<` that begins no tag is text, unknown character references stay. Nothing of
    the chosen parts is dropped or cut. A null id stays null; repeated rows give a row each; an empty table gives
    none. Other columns are not carried, so their names cannot clash.
    """
    pages = df.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("text"),
    )

    def make():
        def work(sources):
            found = [main_text(s) for s in sources]
            return {"main": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}

        return work

    out = map_texts(pages, make, "main string, n_chars long")
    return out.select("page_id", "url", F.col("main").alias("text"), "n_chars")
