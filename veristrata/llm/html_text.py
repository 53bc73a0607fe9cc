"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with the element that holds it. An element's tag path is the sequence of tags
(with their class and id) from the root to it. The method:

1. for each tag path: length of text outside links and number of punctuation marks, each for a node of the path;
2. the two ratios and the path's share of the page's text are fused, sqrt(length * (1 + punctuation) * share), and smoothed
   over the page's nodes in order;
3. a path's score is the mean of its smoothed nodes; it gains a little in article and main and loses a little in what a
   class calls furniture. That breaks ties; on pages of a few words, whose ratios say little, it counts for more;
4. paths whose score reaches the cut, CUT of the best one's or the mean if that is less, are content;
5. what holds a content node is completed, as the article is wanted whole: an article or main in full, but for furniture
   that stays under the cut; elsewhere the rest of the innermost division, and headings beside it.

Fixed meanings of HTML are no matter of scores: scripts, styles, navigation, footers, asides, controls and hidden elements have no
text, a header has none outside an article, forms none unless nothing else has any. Reader comments are told by
their class. Outside article and main, runs of three list items or more that are links only are menus.

Reading and scoring take time linear in the length of the page, however deep or broken it is.

Cases: null html is an empty text; text without any tags is one block; a page without content has an empty text, an empty
table an empty result; equal scores share a side of the cut; unclosed and stray tags are tolerated, and a head or title without an
end closes where the body starts; a tag or comment that the page's end cuts off is dropped; repeated rows are extracted each; very long or deep pages are used whole; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Fixed values of HTML: elements without an end, that don't break a text into blocks, that close others.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FLOWING = INLINE | {"script", "style", "template", "link", "meta"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote", "td", "th", "nav", "aside", "form", "header", "footer"}
#: Elements whose text is never the article's; those of them that hold characters, not tags, up to their end.
NEVER = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "math", "select", "option", "textarea", "button", "input", "nav", "menu", "footer", "aside", "dialog", "fieldset", "audio", "video"}
RAW = {"script", "style", "textarea", "iframe", "xmp", "noembed", "noframes"}
#: Elements that can stand in a head; any other ends it.
HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that divide a page.
DIVISIONS = {"", "html", "body", "div", "section", "article", "main", "center", "form", "header"}
WHOLE = {"article", "main"}
#: Words in a class, id or role that name furniture, and readers' comments. They count on divisions and lists.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer\w*|header|masthead|topbar|toolbar|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|pagination|pager|search|copyright|disclaimer|complementary|contentinfo)(?:$|[\s_-])", re.IGNORECASE)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?:$|[\s_-])", re.IGNORECASE)
NAMED = DIVISIONS | {"ul", "ol", "dl", "table"}
PUNCTUATION = re.compile(r"[.,;:!?。、，！？…]")
HIDDEN = re.compile(r"display\s*:\s*none")
SPACES = " \t\n\r\f"
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?""")
SMOOTH = (0.25, 0.5, 0.25)
#: Share of the best path's score that content reaches; the factor by which article and main gain and furniture loses, raised to
#: 1 + FEW / characters of the page, as ratios of a few words say little.
CUT, FACTOR, FEW = 0.4, 1.25, 500


class Reader:
    """Elements and text nodes of a page.

    Element k has parent[k], tag[k], path[k], division[k] (the innermost division that holds it, itself included), whole[k] (the
    article or main that holds it, or -1), out[k] (2: no text, 1: a form's), named[k] (1: furniture, 2: readers' comments).
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.division, self.whole, self.out, self.named = [-1], [""], [0], [0], [-1], [0], [0]
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # places of open elements in `open`, by tag
        self.scopes: list[int] = []
        self.block = 0
        self.nodes: list[tuple[str, int, int, bool]] = []  # text, block, element, in a link
        self.titles = 0
        self.read(page)

    def read(self, page: str) -> None:
        low = page.lower() if "</" in page else page
        if len(low) != len(page):  # lower case changed a length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
        self.titles = len(re.findall(r"</title[\s/>]", low))
        at, size, missing = 0, len(page), set()
        while at < size:
            lt = page.find("<", at)
            while lt >= 0 and not (lt + 1 < size and (page[lt + 1] in "/!?" or (page[lt + 1].isascii() and page[lt + 1].isalpha()))):
                lt = page.find("<", lt + 1)
            end = size if lt < 0 else lt
            if end > at:
                self.text(references.unescape(page[at:end]))
            if lt < 0:
                return
            what = page[lt + 1]
            if what == "!":
                if page.startswith("<!--", lt):
                    stop = lt + 4 if page.startswith(">", lt + 4) else lt + 5 if page.startswith("->", lt + 4) else -1
                    if stop < 0:
                        stop = page.find("-->", lt + 4)
                        stop = size if stop < 0 else stop + 2
                else:
                    stop = page.find(">", lt)
                at = size if stop < 0 else stop + 1
            elif what == "?":
                stop = page.find(">", lt)
                at = size if stop < 0 else stop + 1
            elif what == "/":
                name = NAME.match(page, lt + 2)
                stop = page.find(">", lt)
                if stop < 0:
                    return
                at = stop + 1
                if name:
                    self.end(name[0].lower())
            else:
                name = NAME.match(page, lt + 1)
                said, at = self.attributes(page, name.end())
                if at > size:
                    return
                tag = name[0].lower()
                self.start(tag, said)
                if tag in RAW and tag not in missing:
                    stop = low.find("</" + tag, at)
                    if stop < 0:
                        missing.add(tag)
                    else:
                        at = stop

    @staticmethod
    def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
        """Class, id, role and what hides; the place behind the tag, beyond the page's end if the tag has no end."""
        size, said = len(page), {}
        while at < size:
            c = page[at]
            if c == ">":
                return said, at + 1
            m = ATTRIBUTE.match(page, at)
            if not m or m.end() == at:
                at += 1
                continue
            at = m.end()
            name = m[1].lower()
            if name in ("class", "id", "role", "hidden", "aria-hidden", "style"):
                value = m[2] or ""
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                said.setdefault(name, references.unescape(value) if "&" in value else value)
        return said, size + 1

    def pop_to(self, k: int) -> None:
        """Closes the open elements from place k on."""
        while len(self.open) > k:
            tag = self.tag[self.open.pop()]
            self.at[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def close(self, tags: tuple[str, ...]) -> None:
        """Closes the nearest of tags and what is open in it, unless a scope lies between."""
        k = max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)
        if k and (not self.scopes or self.scopes[-1] <= k):
            self.pop_to(k)

    def leave_head(self, tag: str) -> None:
        """Closes a title and a head whose ends were left out; a body ends them whatever else is open in them."""
        if self.tag[self.open[-1]] == "title":
            if self.titles or tag in INLINE:
                return
            self.pop_to(len(self.open) - 1)
        if self.at.get("head") and (tag == "body" or self.at["head"][-1] == len(self.open) - 1):
            self.pop_to(self.at["head"][-1])

    def start(self, tag: str, said: dict[str, str]) -> None:
        if tag not in HEAD:
            self.leave_head(tag)
        if tag not in FLOWING:
            self.block += 1
            if tag not in VOID:
                self.close(("p",))
        if tag in SAME_CLOSES:
            self.close(SAME_CLOSES[tag])
        if tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        up = self.open[-1]
        names = " ".join(said[k] for k in ("class", "id", "role") if said.get(k))
        out, named, whole, division = self.out[up], self.named[up], self.whole[up], self.division[up]
        own = 0
        if names and tag in NAMED and tag not in ("body", "html", ""):
            own = 2 if COMMENTS.search(names) else 1 if FURNITURE.search(names) else 0
        if tag in WHOLE and own < 2 and named < 2:
            out, named, whole = (out if out == 2 else 0), 0, len(self.parent)
        elif tag in NEVER or "hidden" in said or said.get("aria-hidden") == "true" or ("style" in said and HIDDEN.search(said["style"])):
            out = 2
        elif tag == "header" and whole < 0:
            out = 2
        elif tag == "form":
            out = max(out, 1)
        named = max(own, named)
        k = len(self.parent)
        if tag in DIVISIONS or (tag == "td" and self.tag[division] in ("", "html", "body")):
            division = k
        step = (self.path[up], f"{tag} {names}" if names else tag)
        for held, value in ((self.parent, up), (self.tag, tag), (self.path, self.paths.setdefault(step, len(self.paths))), (self.division, division), (self.whole, whole), (self.out, out), (self.named, named)):
            held.append(value)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(k)

    def end(self, tag: str) -> None:
        if tag == "title":
            self.titles -= 1
        if tag not in FLOWING:
            self.block += 1
        places = self.at.get(tag)
        if places and not (tag in INLINE and self.scopes and self.scopes[-1] > places[-1]):
            self.pop_to(places[-1])

    def text(self, text: str) -> None:
        if self.tag[self.open[-1]] == "head" and text.strip():
            self.pop_to(len(self.open) - 1)
        self.nodes.append((text, self.block, self.open[-1], bool(self.at.get("a"))))


def path_ratios(paths: list[int], lengths: list[int], marks: list[int]) -> list[float]:
    """The score of each node's path: ratios of length and punctuation and share of the text by path, fused, smoothed in page order, averaged by path."""
    total: dict[int, list[int]] = {}
    for p, n, m in zip(paths, lengths, marks, strict=True):
        held = total.setdefault(p, [0, 0, 0])
        held[0] += n
        held[1] += m
        held[2] += 1
    whole = max(1, sum(lengths))
    ratio = {p: math.sqrt(n / k * (1 + m / k) * n / whole) for p, (n, m, k) in total.items()}
    fused = [ratio[p] for p in paths]
    padded = [fused[0], *fused, fused[-1]]
    sums: dict[int, float] = {}
    for k, p in enumerate(paths):
        sums[p] = sums.get(p, 0.0) + sum(w * padded[k + j] for j, w in enumerate(SMOOTH))
    return [sums[p] / total[p][2] for p in paths]


def _furniture(reader: Reader, elements: list[int], lengths: list[int]) -> list[int]:
    """named, but on a page without article or main an element that holds more than half of the text is no furniture."""
    if any(w >= 0 for w in reader.whole):
        return reader.named
    weight = [0] * len(reader.parent)
    for e, n in zip(elements, lengths, strict=True):
        weight[e] += n
    for k in range(len(weight) - 1, 0, -1):
        weight[reader.parent[k]] += weight[k]
    named = reader.named
    return [named[e] if named[e] == 2 or 2 * weight[e] <= weight[0] else 0 for e in range(len(weight))]


def main_text(page: str | None) -> str:
    """The article of one page, blocks joined by two line ends."""
    if not page:
        return ""
    r = Reader(page)
    most = 0 if any(r.out[e] == 0 and t.strip() for t, _, e, _ in r.nodes) else 1
    nodes = [n for n in r.nodes if r.out[n[2]] <= most]
    full = [n for n in nodes if n[0].strip()]
    if not full:
        return ""
    elements = [n[2] for n in full]
    lengths = [0 if n[3] else len(n[0].strip()) for n in full]
    marks = [0 if n[3] else len(PUNCTUATION.findall(n[0])) for n in full]
    named = _furniture(r, elements, lengths)
    paths = [r.path[e] for e in elements]
    factor = FACTOR ** (1 + FEW / max(1, sum(lengths)))
    scores = [s / factor if named[e] else s * factor if r.whole[e] >= 0 else s for s, e in zip(path_ratios(paths, lengths, marks), elements, strict=True)]
    cut = min(CUT * max(scores), sum(scores) / len(scores))
    chosen = {e for e, s in zip(elements, scores, strict=True) if s >= cut and s > 0 and named[e] < 2}
    if all(named[e] for e in chosen):
        return ""
    wholes = {r.whole[e] for e in chosen} - {-1}
    divisions = {r.division[e] for e in chosen}
    beside = {r.division[r.parent[d]] for d in divisions if d}
    kept: dict[int, bool] = {}
    heading = [False] * len(r.parent)
    for k in range(1, len(r.parent)):
        heading[k] = r.tag[k] in HEADINGS or heading[r.parent[k]]

    def keeps(e: int) -> bool:
        """Whether text held by e, unless chosen, belongs to the content around it."""
        if named[e]:
            return False
        if r.whole[e] in wholes or r.division[e] in divisions:
            return True
        return heading[e] and (r.division[e] in beside or (r.division[e] > 0 and r.division[r.parent[r.division[e]]] in beside))

    blocks: dict[int, list[tuple[str, int, int, bool]]] = {}
    for n in nodes:
        e = n[2]
        if e not in kept:
            kept[e] = e in chosen or keeps(e)
        if kept[e]:
            blocks.setdefault(n[1], []).append(n)
    item = [False] * len(r.parent)
    for k in range(1, len(r.parent)):
        item[k] = r.tag[k] == "li" or item[r.parent[k]]
    out = []
    for part in blocks.values():
        text = " ".join("".join(n[0] for n in part).split())
        if text:
            links = sum(len(n[0].strip()) for n in part if n[3])
            out.append((text, links >= 0.9 * len(text.replace(" ", "")) and item[part[0][2]] and r.whole[part[0][2]] < 0))
    return "\n\n".join(_without_menus(out))


def _without_menus(blocks: list[tuple[str, bool]]) -> list[str]:
    """Leaves out runs of three or more of the blocks marked as items that are links."""
    out, run = [], []
    for text, link in [*blocks, ("", False)]:
        if link:
            run.append(text)
            continue
        if len(run) < 3:
            out += run
        run = []
        if text:
            out.append(text)
    return out


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tasks, SCHEMA)
