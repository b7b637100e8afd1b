"""Main-text extraction by equivalence classes of page tokens.

The pages of a host share templates. Tokens are opening tags at their place in the tree (the path of block elements above them, with
classes and ids, digits folded) and texts without a break at theirs. A token's occurrence vector says how often it occurs on each page of its host;
tokens of equal vectors form an equivalence class. Vectors are never gathered: sums of hashes of (page, count) identify them, so a
host of any size is an aggregation that is reduced on the map side. A class is valid if enough pages have it, it holds elements as well as
texts, and it is ordered: its tokens are numbered by their mean place on the pages, and a page on which they come in another order does not have the class.
Valid classes nest into the host's template: a text is part of it if it stands in an element of its own class. What the template's texts leave open are its slots.

Of the slots, the main one is the page's article elements (main elements, if there are none), else the innermost box with most of the page's
text outside links. All slots stay, with text that the template does not have; outside the main slot, text that differs in digits only is
template too, and link lists and elements that names, roles or tags call furniture go. An element around the main slot, or (but for header, footer,
nav and the like beside an article) with half of the page's text, is never furniture. The template decides inside the main slot; where a host has none (fewer than three pages, or
nothing repeats), asides, forms, menus and adverts inside it go, and text beside articles that hold half of the text goes. Texts that
together are most of a page are never template, as copies of a page repeat them.

A page is read in one forward scan, and elements know their parents by number and their paths by a hash: time and memory are linear in its length, also where tags
are never closed or nest without end. A tag ends at its `>` outside quotes, or where the next `<` outside quotes begins.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one space in page order.

Defined results: null and empty pages give empty text; unclosed and crossing tags are read as browsers do, roughly; an address without
a host forms a host of its own; repeated rows repeat, and count as often in the vectors; a null page_id is an id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, materialise

#: A class is part of a template if at least so many pages and this share of its host's pages have it.
LEAST_PAGES = 3
LEAST_SHARE = 0.1
#: The main slot without a main element holds this share of its page's text; text of the template is on this share of the host's pages.
MAIN_SHARE = 0.6
TEXT_SHARE = 0.5
#: Mean places (0 to 1) that are so close do not tell an order.
ORDER_SLACK = 0.05

#: Elements without content, elements whose content is no markup, and elements that do not break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold no running text; and hints at furniture: elements, and words in classes and ids.
HIDDEN = frozenset("script style noscript template iframe svg button select option input textarea head title object canvas video audio".split())
FURNITURE = frozenset("nav header footer aside form menu dialog figure-nav".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget widgets footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply replies disqus discussion share sharing social related recommended pagination pager "
    "toolbar copyright legal disclaimer skip search form".split()
)
#: The hints that count inside the main slot too. Words that authors also give to parts of their text (header, legal, discussion, alert) are not among them.
INNER = frozenset("nav aside form menu dialog footer".split())
INNER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup comment comments commentlist respond replies disqus share sharing related recommended pagination pager".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN_TAGS = ("article", "main")
#: Elements that can be the main slot of a page without these.
BOXES = frozenset("html body div section table td".split())
MAIN_WORDS = frozenset("article main content post entry story body-content article-body post-content entry-content main-content articlebody".split())
#: An opening tag of the first group ends an open paragraph; of the others, an open one of its own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}

#: A tag without angle brackets in its quotes, which is nearly every one; and the parts of any other.
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+)*+)>")
_OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag, in one scan; comments and declarations have no name.

    The reader may send a position from which to go on, behind what is no markup.
    """
    last = {q: source.rfind(q) for q in "\"'"}
    at = source.find("<")
    while at >= 0:
        if m := _SIMPLE.match(source, at):
            stop = m.end()
            found = (at, stop, m[2].lower(), bool(m[1]), m[3])
        elif m := _OPENING.match(source, at):
            end = m.end()
            while True:  # to the first > or < outside quotes; a quote that is never closed is a character like others
                end = _PLAIN.match(source, end).end()
                if end >= len(source) or source[end] in "<>":
                    break
                end = end + 1 if end >= last[source[end]] else source.index(source[end], end + 1) + 1
            stop = min(end + 1, len(source)) if source[end : end + 1] != "<" else end
            found = (at, stop, m[2].lower(), bool(m[1]), source[m.end() : end])
        elif (opened := source[at + 1 : at + 2]) and opened in "!?/":
            mark = "-->" if source.startswith("<!--", at) else "]]>" if source.startswith("<![CDATA[", at) else ">"
            end = source.find(mark, at + (4 if mark == "-->" else 1))
            stop = len(source) if end < 0 else end + len(mark)
            found = (at, stop, "", False, "")
        else:
            at = source.find("<", at + 1)
            continue
        further = yield found
        at = source.find("<", max(stop, further or 0))


class Page:
    """Text pieces of a page by the block elements that hold them; elements in page order."""

    def __init__(self, source: str):
        #: Of each block element: tag, number of its path, depth, parent, whether its text is hidden (inherited), and the hint: 0 none, 1 outside the main slot, 2 anywhere.
        self.tags: list[str] = ["#"]
        self.paths: list[int] = [0]
        self.depths: list[int] = [0]
        self.parents: list[int] = [-1]
        self.hidden: list[bool] = [False]
        self.hints: list[int] = [0]
        #: Pieces: (element, text or None for a break, whether in a link).
        self.pieces: list[tuple[int, str | None, bool]] = []
        self._read(source)
        #: Runs, text without a break: (element, its pieces, characters outside links, characters).
        self.runs: list[tuple[int, list[str], int, int]] = []
        self._join()

    def _read(self, source: str) -> None:
        open_, names = [0], Counter()
        links = 0
        hidden: list[tuple[str, int]] = []  # inline elements that are not shown
        at, pieces = 0, self.pieces
        scan = tags(source)
        found = next(scan, None)
        while found:
            start, stop, tag, closes, attributes = found
            further = None
            if start > at and not hidden:
                pieces.append((open_[-1], source[at:start], links > 0))
            at = stop
            if not tag:
                pass
            elif closes:
                if hidden and hidden[-1] == (tag, len(open_)):
                    hidden.pop()
                elif tag == "a":
                    links = max(0, links - 1)
                elif tag not in INLINE:
                    if names[tag]:
                        while self.tags[open_[-1]] != tag:
                            names[self.tags[open_.pop()]] -= 1
                        names[self.tags[open_.pop()]] -= 1
                        while hidden and hidden[-1][1] > len(open_):
                            hidden.pop()
                        links = 0
                    pieces.append((open_[-1], None, False))
            else:
                closed = attributes.endswith("/")
                if tag in RAW and not closed:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    self._element(tag, attributes, open_[-1])
                    at = further = end.end() if end else len(source)
                elif tag in INLINE:
                    if tag == "a" and not closed:
                        links += 1
                    elif tag not in VOID and not closed and self._names(attributes)[2]:
                        hidden.append((tag, len(open_)))
                elif tag in VOID:
                    pieces.append((open_[-1], None, False))
                else:
                    ended = SIBLINGS.get(tag, ())
                    while len(open_) > 1 and ((top := self.tags[open_[-1]]) in ended or top == "p" and tag in ENDS_P):
                        names[top] -= 1
                        open_.pop()
                    number_ = self._element(tag, attributes, open_[-1])
                    pieces.append((open_[-1], None, False))
                    if not closed:
                        open_.append(number_)
                        names[tag] += 1
            try:
                found = scan.send(further)
            except StopIteration:
                found = None
        if at < len(source) and not hidden:
            pieces.append((open_[-1], source[at:], links > 0))

    @staticmethod
    def _names(attributes: str) -> tuple[frozenset[str], str, bool]:
        if "=" not in attributes:
            return frozenset(), "", "hidden" in attributes
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        named = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        off = "display:none" in found.get("style", "").replace(" ", "").lower()
        return frozenset(named), found.get("role", "").lower(), off

    @staticmethod
    def _hint(tag: str, named: frozenset[str], role: str) -> int:
        words = {w for n in named if n not in MAIN_WORDS for w in _WORDS.findall(n)}
        if tag in INNER or not INNER_WORDS.isdisjoint(words):
            return 2
        return int(tag in FURNITURE or role in FURNITURE_ROLES or not FURNITURE_WORDS.isdisjoint(words))

    def _element(self, tag: str, attributes: str, parent: int) -> int:
        named, role, off = self._names(attributes) if attributes else (frozenset(), "", False)
        mark = ".".join(sorted(_DIGITS.sub("0", n) for n in named)) if named else ""
        self.tags.append(tag)
        self.paths.append(number(f"{self.paths[parent]}/{tag}.{mark}"))
        self.depths.append(self.depths[parent] + 1)
        self.parents.append(parent)
        self.hidden.append(self.hidden[parent] or off or tag in HIDDEN)
        self.hints.append(0 if tag in ("html", "body") else self._hint(tag, named, role) if named or role else 2 if tag in INNER else int(tag in FURNITURE))
        return len(self.tags) - 1

    def _join(self) -> None:
        now, texts, plain, whole = -1, [], 0, 0
        for element, text, link in (*self.pieces, (-1, None, False)):
            if text is None or element != now:
                if whole:
                    self.runs.append((now, texts, plain, whole))
                now, texts, plain, whole = element, [], 0, 0
            if text is not None and not self.hidden[element]:
                size = len(text.strip())
                texts.append(text)
                whole += size
                plain += 0 if link else size

    def tokens(self) -> list[tuple[int, int, int]]:
        """Of each run: the numbers of its text token, of the same with digits folded (0 without digits, or without letters), and its element."""
        found = []
        for element, texts, _, _ in self.runs:
            text = " ".join("".join(texts).split())
            at = self.paths[element]
            loose = 0
            if _DIGITS.search(text):
                folded = _DIGITS.sub("0", text)
                loose = number(f"{at}\1{folded}") if any(map(str.isalpha, folded)) else 0
            found.append((number(f"{at}\0{text}"), loose, element))
        return found

    def counts(self) -> dict[tuple[int, int], tuple[int, float]]:
        """Occurrences and mean place of each token on the page: (0, opening tag at its place), (1, text), (2, text with digits folded)."""
        found: dict[tuple[int, int], list[int]] = {}

        def add(kind: int, token: int, place: int) -> None:
            if entry := found.get((kind, token)):
                entry[0] += 1
                entry[1] += place
            else:
                found[kind, token] = [1, place]

        for e, path in enumerate(self.paths):
            add(0, path, e)
        highest = 0  # texts stand behind the last element that one of them before has been in
        for i, (exact, loose, e) in enumerate(self.tokens()):
            highest = max(highest, e)
            add(1, exact, highest + i)
            if loose:
                add(2, loose, highest + i)
        length = 1 + len(self.tags) + len(self.runs)
        return {token: (n, places / n / length) for token, (n, places) in found.items()}

    def ordered(self, template: dict[int, tuple[int, float]]) -> dict[int, int]:
        """The template's tokens with their classes, without classes whose elements the page has in another order than their mean places."""
        last: dict[int, float] = {}
        bad: set[int] = set()
        first = set()
        for path in self.paths:
            if path in template and path not in first:
                first.add(path)
                of, place = template[path]
                if place < last.get(of, place) - ORDER_SLACK:
                    bad.add(of)
                last[of] = max(place, last.get(of, place))
        return {token: of for token, (of, _) in template.items() if of not in bad}

    def fixed(self, template: dict[int, int]) -> tuple[list[bool], list[bool]]:
        """Of each run: whether it is text of the template, as it is and with digits folded: of a class that also has an element around it."""
        exact, loose = [False] * len(self.runs), [False] * len(self.runs)
        if not template:
            return exact, loose
        texts: dict[int, list[tuple[int, int, int]]] = {}
        for i, (tight, wide, e) in enumerate(self.tokens()):
            if tight in template or wide in template:
                texts.setdefault(e, []).append((i, tight, wide))
        around: Counter[int] = Counter()  # classes of the elements that are open
        stack: list[int] = []
        for e, path in enumerate(self.paths):
            while stack and stack[-1] != self.parents[e]:
                around[template.get(self.paths[stack.pop()], 0)] -= 1
            stack.append(e)
            around[template.get(path, 0)] += 1
            for i, tight, wide in texts.get(e, ()):
                exact[i] = tight in template and around[template[tight]] > 0
                loose[i] = exact[i] or bool(wide) and wide in template and around[template[wide]] > 0
        return exact, loose

    def weights(self, dropped: list[bool]) -> list[int]:
        """Of each element: characters of text at or below it outside links, but for the dropped runs."""
        found = [0] * len(self.tags)
        for (element, _, plain, _), gone in zip(self.runs, dropped, strict=True):
            if not gone:
                found[element] += plain
        for element in range(len(found) - 1, 0, -1):  # children follow their parents
            found[self.parents[element]] += found[element]
        return found

    def marked(self, weights: list[int]) -> list[int]:
        """The outermost article elements (else main elements) with text; those that a hint speaks against only if there are no others."""
        for tag in MAIN_TAGS:
            found = [e for e in range(1, len(self.tags)) if self.tags[e] == tag and weights[e]]
            if found := [e for e in found if not self.hints[e]] or found:
                return found
        return []

    def kept(self, template: dict[int, tuple[int, float]]) -> list[bool]:
        """Of each run, whether it is main text."""
        exact, loose = self.fixed(self.ordered(template))
        weights, total = self.weights(exact), sum(plain for _, _, plain, _ in self.runs)
        if weights[0] * 2 < total:  # copies of a page: the template is not what holds most of its text
            exact, loose = [False] * len(exact), [False] * len(loose)
            weights = self.weights(exact)
        total = weights[0]
        marked = self.marked(weights)
        main = marked or [max((e for e in range(len(self.tags)) if (e == 0 or self.tags[e] in BOXES) and weights[e] >= MAIN_SHARE * total), key=lambda e: (self.depths[e], weights[e]))]
        holds, main = set(), set(main)  # the main slot and what is around it
        for e in main:
            while e >= 0 and e not in holds:
                holds.add(e)
                e = self.parents[e]
        inside = [False] * len(self.tags)
        gone = [False] * len(self.tags)
        for e in range(len(self.tags)):
            above = self.parents[e]
            inside[e] = e in main or e > 0 and inside[above]
            least = 2 if inside[e] else 1  # whatever the host's other pages say: furniture of its own text is on no template
            most = weights[e] * 2 >= total and (not marked or self.tags[e] not in FURNITURE or self.tags[e] == "form")
            furniture = self.hints[e] >= least and e not in holds and not most
            gone[e] = e > 0 and gone[above] or furniture
        alone = bool(marked) and not template and sum(plain for e, _, plain, _ in self.runs if inside[e]) * 2 >= total
        keep = []
        for (e, _, plain, _), tight, wide in zip(self.runs, exact, loose, strict=True):
            if inside[e]:
                keep.append(not gone[e] and not tight)
            else:
                keep.append(not gone[e] and not wide and not alone and (plain > 0 or not total))
        return keep

    def text(self, template: dict[int, tuple[int, float]] | None = None) -> str:
        keep = self.kept(template or {})
        parts = ["".join(map(html.unescape, texts)) for (_, texts, _, _), good in zip(self.runs, keep, strict=True) if good]
        return " ".join(" ".join(parts).split())


def number(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 2) - (1 << 63)


def host(url):
    """The host of an address, in lower case."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), url, F.lit("")))


_TOKENS_DDL = "host string, kind int, token bigint, low bigint, high bigint, places double, pages bigint"


def tokens(pages: DataFrame) -> DataFrame:
    """(host, kind, token, low, high, places, pages): of each host, the tokens of a batch with what they add to their occurrence vectors and mean places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int, int], list] = {}
            for page, at, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for (kind, token), (n, place) in Page(source or "").counts().items():
                    entry = found.setdefault((at, kind, token), [0, 0, 0.0, 0])
                    mark = xxhash.xxh64_intdigest(f"{page}:{n}", 1)
                    entry[0] += mark & 0xFFFFFFFF
                    entry[1] += mark >> 32
                    entry[2] += place
                    entry[3] += 1
            if found:
                hosts, kinds, numbers = zip(*found, strict=True)
                columns = zip(pa.schema([("low", pa.int64()), ("high", pa.int64()), ("places", pa.float64()), ("pages", pa.int64())]), zip(*found.values(), strict=True), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(kinds, pa.int32()), pa.array(numbers, pa.int64()), *(pa.array(c, f.type) for f, c in columns)], names=["host", "kind", "token", "low", "high", "places", "pages"])

    return pages.mapInArrow(run, _TOKENS_DDL)


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, members): of each host, the tokens (token, class, place) of its valid classes that hold both elements and text."""
    # Sums of halves of hashes do not overflow, and do not depend on how rows are grouped; a page's rows count each time they occur.
    vector = F.xxhash64(F.sum("low"), F.sum("high")).alias("vector")
    place = F.round(F.sum("places") / F.sum("pages"), 6).alias("place")
    totals = tokens(pages).groupBy("host", "kind", "token").agg(vector, place, F.sum("pages").alias("pages")).where(F.col("pages") >= least_pages)
    totals = materialise(totals, "tokens")
    sizes = totals.groupBy("host").agg(F.max("pages").alias("of"))
    # Tokens of one occurrence vector are one class; a class is valid by its support, and on each page by its order.
    classes = totals.groupBy("host", "vector", "pages").agg(F.collect_list(F.struct("token", "vector", "place")).alias("members"), F.min("kind").alias("first"), F.max("kind").alias("last"))
    share = max(least_share, TEXT_SHARE)
    valid = classes.join(sizes, "host").where((F.col("pages") >= least_pages) & (F.col("pages") >= F.col("of") * share) & (F.col("first") == 0) & (F.col("last") > 0))
    return valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("members"))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    bound_batches(pages.sparkSession)
    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[source].cast("string").alias("html"), host(pages[url].cast("string")).alias("host"))
    found = materialise(templates(rows.select("page_id", "host", "html")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = ({m["token"]: (m["vector"], m["place"]) for m in found or ()} for found in batch.column(3).to_pylist())
            texts = [Page(source).text(template) if source else "" for source, template in zip(batch.column(2).to_pylist(), members, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "members")
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
