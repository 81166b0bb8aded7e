"""Main text of web pages by composite text density.

A page is parsed into a tree (tolerantly: unclosed, misnested and implied tags are normal), and elements that are
never article text go: scripts, styles, forms, menus, page headers and footers, sidebars, notices, adverts, reader
comments, by element, role, or whole words of class and id. Within the article such a word isn't enough where it may be
a topic (`id="search-results"`, `class="teaser"`): headings and text stay, boxes go by a name that can mean nothing
else or when most of their text is in links; lists of links, such as references, stay too. For every remaining node with C characters and T tags,
of which LC and LT are in links, the composite density is

    C/T * log_b( (C/LC) * (T/LT) ),   b = ln( (C/nLC) * LC + (LC_body/C_body) * C + e ),   nLC = C - LC

with counts of zero taken as one; the counts are those of the whole page, its furniture included, so that menus and
the like lower the density of what wraps them. A node's density sum is the sum over its child elements without
furniture. The block with the largest sum is the article's core; the smallest density on its path up to the body is the
threshold (a quarter of the core's own density at least), and of every other subtree reaching the threshold on such a path the node with the largest sum is taken as
well, unless it is mostly links. Headings, paragraphs and lists beside a taken block, inside of the same wrapper, go
with it. An article or main element is never chosen for its name: the one that holds the core bounds where the article
ends. Text is joined in page order.

Defined results: null or empty html gives ''; a page without markup is its text; text is cut nowhere; repeated
rows and pages give equal results; extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import ship

# --- fixed values: names of HTML elements and of page furniture ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul br caption".split()
)
DROP_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe button select textarea input object embed svg math canvas audio video map dialog menu "
    "head title fieldset label datalist".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer sidebar sidenav sidebox comment comments commentlist commentbox disqus reply replies respond cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing sharebar social related "
    "recommended recommendations widget widgets toolbar pagination pager masthead topbar skiplink paywall banner banners adsbygoogle adbox teaser "
    "teasers outbrain taboola search searchbox toc copyright discussion".split()
)
#: Names that are never a topic, and names that as the whole class of a box aren't one either.
CERTAIN = frozenset(
    "adsense adslot adsbygoogle adbox navbar breadcrumb breadcrumbs sidebar sidenav sidebox comments commentlist commentbox disqus gdpr newsletter sharebar "
    "pagination pager masthead topbar skiplink paywall outbrain taboola searchbox".split()
)
BOXED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo nav menu menus footer share sharing social subscribe popup modal widget widgets toolbar banner banners cookie cookies".split())
#: Words that with words of furniture make up a name for a part of the page: ad-slot, related-posts.
PARTS = frozenset("slot box container wrapper wrap block list bar top left right bottom area unit units link links post posts articles stories button buttons icons inner outer main panel holder header content form".split())
BOXES = frozenset("div section ul ol dl table header center ins details".split())
CLOSES_P = BLOCK - {"body", "html", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of an article, never the whole: their inline children would outweigh the article's paragraphs.
PART = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption figure caption th tr thead tbody tfoot ul ol dl hr br summary".split())
#: An element that opens closes an open one of these, up to the nearest of the barriers.
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
SCOPE = frozenset("html body table td th caption button object article section div main".split())

#: The threshold is at least this share of the core's density: a body full of links must not let every short text in.
LEAST = 0.25

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_UNFINISHED = re.compile(r"<[!?/]")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


class Page:
    """The tree of one page as parallel lists; a parent's index is below its children's."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop = ["html"], [-1], [False]
        self.headed = [False]  # named a header by class or id
        self.weak = [False]  # furniture by a name that may be a topic, too
        self.text: list[tuple[int, str]] = []  # (node, text), in page order; '\n' marks a block border
        self._parse(source)

    def _cut(self, at: int, stack: list[int], open_at: dict[str, list[int]]) -> None:
        """Close everything from this place of the stack on."""
        for node in stack[at:]:
            open_at[self.tag[node]].pop()
        del stack[at:]

    def _open(self, tag: str, attrs: str, stack: list[int], open_at: dict[str, list[int]]) -> None:
        last = lambda names: max((open_at[t][-1] for t in names if open_at.get(t)), default=-1)
        if tag in CLOSES_P:
            self._close("p", stack, open_at)
        if tag in CLOSED_BY:
            same, barrier = CLOSED_BY[tag]
            at = last(same)
            if at > max(last(barrier), 0):
                self._cut(at, stack, open_at)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.drop.append(self._furniture(tag, attrs))
        self.weak.append(self.drop[-1] and self._may_be_topic(tag, attrs))
        self.headed.append(tag not in ("html", "body", "main", "article", "header") and "header" in attrs.lower() and self._named(attrs, "header"))
        if tag in BLOCK:
            self.text.append((stack[-1], "\n"))
        if tag not in VOID:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def _close(self, tag: str, stack: list[int], open_at: dict[str, list[int]]) -> None:
        """The nearest open element of this name, unless a barrier stands before it; places are kept by name."""
        found = open_at.get(tag)
        if not found or found[-1] < 1:
            return
        at = found[-1]
        if (tag == "p" or tag not in BLOCK) and any(open_at.get(t) and open_at[t][-1] > at for t in SCOPE):
            return
        self._cut(at, stack, open_at)
        self.text.append((stack[-1], "\n" if tag in BLOCK else ""))

    @staticmethod
    def _furniture(tag: str, attrs: str) -> bool:
        if tag in DROP_TAGS:
            return True
        if not attrs or tag in ("html", "body", "main", "article"):
            return False
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if not DROP_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(value)):
                    return True
            elif name == "role":
                if not DROP_ROLES.isdisjoint(value.lower().split()):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
        return False

    @staticmethod
    def _may_be_topic(tag: str, attrs: str) -> bool:
        """Furniture by nothing but words of class and id that inside an article may as well name what the text is about."""
        if tag in DROP_TAGS:
            return False
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name == "role" and not DROP_ROLES.isdisjoint(value.lower().split()) or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return False
            if name in ("class", "id") and tag not in HEADINGS:
                for one in value.split():
                    words = {w.lower() for w in _WORDS.findall(one)}
                    named = words & DROP_WORDS
                    if named & CERTAIN or named and len(words) > 1 and words <= DROP_WORDS | PARTS or name == "class" and tag in BOXES and tag != "section" and len(words) == 1 and words <= BOXED:
                        return False
        return True

    @staticmethod
    def _named(attrs: str, word: str) -> bool:
        return any(m[1].lower() in ("class", "id") and word in (w.lower() for w in _WORDS.findall(m[2] or m[3] or m[4] or "")) for m in _ATTR.finditer(attrs))

    def _parse(self, s: str) -> None:
        stack, at, n, text = [0], 0, len(s), self.text
        open_at: dict[str, list[int]] = {"html": [0]}
        last, once = s.rfind(">"), set()
        while at < n:
            if at > last:  # no tag can end any more: text, up to an unfinished comment or end tag
                m = _UNFINISHED.search(s, at)
                text.append((stack[-1], s[at : m.start() if m else n]))
                break
            m = _TAG.search(s, at)
            if m is None:
                text.append((stack[-1], s[at:]))
                break
            if m.start() > at:
                text.append((stack[-1], s[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(tag, stack, open_at)
                continue
            attrs = m[3] or m[6] or ""
            if tag in ("html", "body"):
                if tag in once:
                    continue
                once.add(tag)
            self._open(tag, attrs, stack, open_at)
            if tag in RAW and not attrs.endswith("/"):
                end = _raw_end(tag).search(s, at)
                at = end.end() if end else n
                self._cut(len(stack) - 1, stack, open_at)

    def main_text(self) -> str:
        """The article is found first, then what its names alone had removed from it comes back."""
        n = len(self.tag)
        stays = [False] * n
        inside = [False] * n
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = inside[p] or self.tag[p] in ("article", "main")
            stays[i] = self.weak[i] and inside[i]
        best, text, _, _ = self._extract(stays)
        if best < 0 or not any(self.weak):
            return text
        under = [False] * n
        for i in range(n):
            under[i] = i == best or i > 0 and under[self.parent[i]]
            stays[i] = stays[i] or self.weak[i] and under[i]
        if not any(stays):
            return text
        _, _, chars, links = self._extract(stays)
        boxes = [i for i in range(n) if stays[i] and self.tag[i] in BOXES and 2 * links[i] > chars[i]]
        for i in boxes:
            stays[i] = False
        return self._extract(stays)[1]

    def _extract(self, stays: list[bool]) -> tuple[int, str, list[int], list[int]]:
        """The chosen node (-1: none), the main text, and every node's characters and those in links."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        holds = [t in ("article", "main", "h1") for t in tag]
        for i in range(n - 1, 0, -1):
            if holds[i]:
                holds[parent[i]] = True
        dropped, inside = [d and not k for d, k in zip(self.drop, stays)], [False] * n
        for i in range(1, n):
            p = parent[i]
            inside[i] = inside[p] or tag[p] in ("article", "main")
            if tag[i] == "header" and not (inside[i] and holds[i]) or self.headed[i] and not holds[i]:
                dropped[i] = True
            elif dropped[i] and tag[i] not in DROP_TAGS and holds[i]:
                dropped[i] = False  # a wrapper of the article isn't furniture, whatever it's called
            dropped[i] = dropped[i] or dropped[p]
        link = [False] * n
        for i in range(1, n):
            link[i] = link[parent[i]] or tag[i] == "a"
        texts = [(i, html.unescape(t) if "&" in t else t) for i, t in self.text]
        shown = [not d for d in dropped]
        # of the whole page: what densities are made of; of the page without furniture: what can be taken
        all_chars, all_links, tags, link_tags = self._counts(texts, link, [True] * n)
        chars, links, _, anchors = self._counts(texts, link, shown)
        body = tag.index("body") if "body" in tag else 0
        if not all_chars[body]:
            body = 0
        density = self._densities(all_chars, all_links, tags, link_tags, body)
        total = [0.0] * n  # density sums, over children that aren't furniture
        for i in range(1, n):
            if shown[i] and chars[i]:
                total[parent[i]] += density[i]
        under = [False] * n
        for i in range(n):
            under[i] = i == body or i > 0 and under[parent[i]] and shown[i]
        nodes = [i for i in range(n) if under[i] and chars[i]]
        if not nodes:
            return -1, "", chars, links
        whole = lambda i: i == body or tag[i] not in PART and tag[i] in BLOCK
        best = max((i for i in nodes if whole(i)), key=lambda i: (total[i], -i))
        bound = self._bound(best, body, chars)
        path, i = [best], best
        while i != body:
            i = parent[i]
            path.append(i)
        threshold = max(min(density[i] for i in path), LEAST * density[best])
        top = list(range(n))  # within each subtree the node with the largest density sum
        for i in reversed(nodes):
            if i != body:
                p = parent[i]
                if total[top[i]] > total[top[p]] and whole(top[i]):
                    top[p] = top[i]
        chosen, reach, within = [False] * n, [False] * n, [False] * n
        chosen[best] = True
        chosen[bound] = chosen[bound] or bound != body
        for i in nodes:
            within[i] = i == bound or i != body and within[parent[i]]
            if not within[i]:
                continue
            reach[i] = (i == bound or reach[parent[i]]) and density[i] >= threshold
            if reach[i] and i != bound and 2 * links[top[i]] <= chars[top[i]]:
                chosen[top[i]] = True
            if tag[i] == "h1" and 2 * links[i] <= chars[i]:
                chosen[i] = True
        wrappers = set(path[1:]) - {body}
        for i in nodes:  # headings, paragraphs and lists beside what was taken, in the same wrapper
            if within[i] and tag[i] in PART and parent[i] in wrappers and 2 * links[i] <= chars[i]:
                chosen[i] = True
        menu = [False] * n
        # a block of its own holds the article and its lists of links; in a body without one they must stand within its text
        own = best != body
        amid = [own] * n
        if not own:
            prose = [i for i in nodes if tag[i] in PART and chars[i] > 2 * links[i] and not (tag[i] in ("ul", "ol", "dl", "li"))]
            for i in range(n):
                amid[i] = bool(prose) and prose[0] < i < prose[-1]
        of_best = [False] * n
        for i in range(n):
            of_best[i] = i == best or i > 0 and of_best[parent[i]]
            if i and under[i]:
                chosen[i] = chosen[i] or chosen[parent[i]]
                lists = tag[i] in ("ul", "ol", "div", "section", "table", "dl") and anchors[i] > 1 and 5 * links[i] > 4 * chars[i] and i != best and not (of_best[i] and amid[i])
                menu[i] = menu[parent[i]] or lists
        return best, " ".join("".join([t for i, t in texts if chosen[i] and shown[i] and not menu[i]]).split()), chars, links

    def _counts(self, texts: list[tuple[int, str]], link: list[bool], shown: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, characters in links, elements and links below each node, without the nodes not shown."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i, t in texts:
            if shown[i]:
                c = len(t) - t.count(" ") - t.count("\n")
                chars[i] += c
                if link[i]:
                    links[i] += c
        for i in range(n - 1, 0, -1):
            if shown[i]:
                p = parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        return chars, links, tags, link_tags

    @staticmethod
    def _densities(chars: list[int], links: list[int], tags: list[int], link_tags: list[int], body: int) -> list[float]:
        """The composite text density of every node."""
        whole, of_links = max(chars[body], 1), links[body]
        out = []
        for c, l, t, lt in zip(chars, links, tags, link_tags):
            t = max(t, 1)
            ratio = c / max(l, 1) * (t / max(lt, 1))
            base = math.log(c / max(c - l, 1) * l + of_links / whole * c + math.e)
            out.append(c / t * max(0.0, math.log(ratio) / math.log(base) if base > 1 and ratio > 0 else math.log(max(ratio, 1))))
        return out

    def _bound(self, best: int, body: int, chars: list[int]) -> int:
        """Where the article ends: the article element around the core, or main if that has twice its text; else the body."""
        found = {}
        i = best
        while i != body:
            found.setdefault(self.tag[i], i)
            i = self.parent[i]
        article, main = found.get("article", body), found.get("main", body)
        if body in (article, main):
            return article if main == body else main
        return article if 2 * chars[article] >= chars[main] else main


def extract(source: str | None) -> str:
    """The main text of one page."""
    return Page(source).main_text() if source else ""


def main_texts(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and the main text of every page; one narrow Arrow pass."""
    ship(pages.sparkSession)
    src = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = pa.array([extract(x.as_py()) for x in part.column(part.num_columns - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], names=[*keep, "text"])

    return src.mapInArrow(run, schema)
