"""HTML extraction with inferred wrappers: union-free regular expressions over token streams.

A page's token stream is read as nested elements.  Its skeleton is a union-free expression: tags, text slots, ``+`` for
repeated and ``?`` for optional groups.  Neighbouring elements of one kind become a repeated group whose inside is
the alignment of all of them; what one of two aligned streams lacks becomes optional.  Skeletons of a host are
aligned one after the other, in rounds of bounded groups, into the host's wrapper.  The wrapper tells which element holds the
article, and which of its text slots hold the same text on nearly all different pages of the host: those are template, the others are
the page's own.  Pages are then read through it.  Word lists tell adverts, notices and comments whose texts differ from page to page; they never take
an element that holds most of a page's text for a mere part of its class.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
MARKS = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag ends an open element of these kinds, up to the nearest of the holders.
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
HOLDERS = frozenset("html body article section main div ul ol dl table form aside nav footer header blockquote".split())
OUTSIDE = frozenset("nav aside footer form button menu dialog fieldset input object embed audio video canvas select svg".split())
# Words in class, id or role that mark what is not the article.
MARKED = frozenset(
    "ad ads advert advertisement adverts adsbygoogle sponsored sponsor promo banner sidebar comments comment replies respond discussion disqus notice notices cookie"
    " cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs menu nav navbar"
    " navigation pagination pager footer masthead toolbar widget skip login search".split()
)
ARTICLE = frozenset("articlebody article-body post-content entry-content article-content story-body main-content".split())
HOLDING = ARTICLE | {"content", "main", "post"}
REPLIES = frozenset("comments comment replies reply respond discussion disqus".split())
# Beginnings of classes that tell a state of the page, as in "has-sidebar".
STATES = frozenset("has no with without is not show hide".split())
# Elements that a part of a class or a whole id may mark; sentences and headings are marked by whole classes alone.
GROUPS = frozenset("div section ul ol dl table span a figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SENTENCES = HEADINGS | frozenset("p li dd td th blockquote span em strong b i".split())
# Skeletons aligned in one group.
GROUP_ROWS = 512
# A slot is template if this share of a host's different pages holds the same text there, from so many pages on.
TEMPLATE_SHARE = 0.9
TEMPLATE_PAGES = 8
# Levels of a skeleton; what lies deeper is one text slot there.  Pages themselves are searched and read at any depth.
LEVELS = 64


class Element:
    __slots__ = ("children", "kind", "marks", "name", "words")

    def __init__(self, name: str, marks: frozenset[str] = frozenset(), kinds: frozenset[str] | None = None, words: frozenset[str] | None = None):
        self.name, self.marks, self.children = name, marks, []
        self.words = marks if words is None else words
        self.kind = name if name != "div" and name != "section" and name != "span" else ".".join([name, *sorted(marks if kinds is None else kinds)])


def _marks(attributes: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Words of all marks, of those that make the kind (an id that is not known as an article's often names one page only), and of all but ids."""
    if "=" not in attributes:
        return frozenset(), frozenset(), frozenset()
    found = [(m[1].lower(), w) for m in MARKS.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()]
    return frozenset(w for _, w in found), frozenset(w for name, w in found if name != "id" or w in MARKED or w in HOLDING), frozenset(w for name, w in found if name != "id")


def parse(page: str) -> Element:
    """Nested elements of a page; texts are strings among the children.  Raw elements and comments are left out."""
    root = Element("#page")
    stack = [root]
    end = 0
    for m in TOKEN.finditer(page):
        if m.start() > end:
            stack[-1].children.append(page[end : m.start()])
        end = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name not in HOLDERS and stack[k].name in HOLDERS:
                    break
            continue
        if name in BLOCKS:
            # A block ends an open paragraph; items and cells end their like.
            ended = ENDS.get(name, frozenset()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ended:
                    del stack[k:]
                    break
                if stack[k].name in HOLDERS:
                    break
        element = Element(name, *_marks(m[4]))
        stack[-1].children.append(element)
        if name not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(element)
    if end < len(page):
        stack[-1].children.append(page[end:])
    return root


def outside(e: Element, in_article: bool) -> bool:
    """Whether an element is no part of an article by its tag or a whole class or role (of groups: or id)."""
    if e.name in OUTSIDE or (e.name in ("header", "head") and not in_article):
        return True
    return e.name not in ("html", "body") and bool((e.marks if e.name in GROUPS else e.words) & MARKED)


def _hints(e: Element) -> set[str]:
    """Parts of a group's classes that hint at something outside of the article."""
    if e.name not in GROUPS or not e.words or e.words & ARTICLE:
        return set()
    parts = [re.split(r"[-_]+", w) for w in e.words]
    return {p for ps in parts if ps[0] not in STATES for p in ps} & MARKED


def hinted_out(root: Element) -> set[Element]:
    """Elements of a page that parts of their classes put outside, but for those that hold most of the page's text (replies go anyway)."""
    order = [root]
    for e in order:
        order += [c for c in e.children if not isinstance(c, str) and c.name not in OUTSIDE]
    hinted = [(e, _hints(e)) for e in order]
    if not any(h for _, h in hinted):
        return set()
    size: dict[Element, int] = {}
    # Every element comes after the one that holds it.
    for e in reversed(order):
        size[e] = sum(len(c.strip()) if isinstance(c, str) else size.get(c, 0) for c in e.children)
    return {e for e, h in hinted if h & REPLIES or (h and 2 * size[e] <= size[root])}


# A skeleton node: [kind, flags, children]; flags hold "+" and "?"; "#" is a text slot.


def skeleton(e: Element, levels: int = LEVELS) -> list:
    """The union-free expression of one page, ``levels`` deep."""
    if not levels:
        return [e.kind, "", [["#", "", []]] if e.children else []]
    nodes: list = []
    for child in e.children:
        if isinstance(child, str):
            node = ["#", "", []] if child.strip() else None
        else:
            node = skeleton(child, levels - 1)
        if node is None:
            continue
        if nodes and nodes[-1][0] == node[0]:
            nodes[-1] = _merged(nodes[-1], node)
            if node[0] != "#":
                nodes[-1][1] = _flags(nodes[-1][1], "+")
        else:
            nodes.append(node)
    return [e.kind, "", nodes]


def _flags(*flags: str) -> str:
    joined = "".join(flags)
    return ("+" if "+" in joined else "") + ("?" if "?" in joined else "")


def _merged(a: list, b: list) -> list:
    return [a[0], _flags(a[1], b[1]), align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """Alignment of two streams: what both have is merged, what one lacks is optional."""
    if a == b:
        return a
    out = []
    names = [n[0] for n in a], [n[0] for n in b]
    for what, i, j, k, m in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
        if what == "equal":
            out += [_merged(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[n[0], _flags(n[1], "?"), n[2]] for n in (*a[i:j], *b[k:m])]
    # Alternatives of one kind next to each other are a repeated group.
    tidy: list = []
    for n in out:
        if tidy and tidy[-1][0] == n[0]:
            tidy[-1] = _merged(tidy[-1], n)
            tidy[-1][1] = _flags(tidy[-1][1], "+" if n[0] != "#" else "")
        else:
            tidy.append(n)
    return tidy


def wrapper(skeletons: Iterator[str]) -> list:
    """Skeletons (or wrappers) of one host aligned one after the other; an expression met before changes nothing."""
    found, met = None, set()
    for text in skeletons:
        if text in met:
            continue
        met.add(text)
        node = json.loads(text)
        found = node if found is None else _merged(found, node)
    return found or ["#page", "", []]


def article_paths(node: list, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths in a wrapper to the elements that may hold the article: outermost ``article``, then ``main``, then marked containers."""
    found: dict[str, list[tuple[str, ...]]] = {"article": [], "main": [], "marked": []}

    def walk(n: list, path: tuple[str, ...]) -> None:
        name, *marks = n[0].split(".")
        here = Element(name, frozenset(marks))
        if name in OUTSIDE:
            return
        role = name if name in ("article", "main") else "marked" if here.marks & HOLDING else None
        if role and _slots(n):
            found[role].append((*path, n[0]))
            if role == "article":
                return
        for c in n[2]:
            walk(c, (*path, n[0]))

    walk(node, path)
    return [p for role in ("article", "main", "marked") for p in found[role]]


def _slots(n: list) -> bool:
    return n[0] == "#" or any(_slots(c) for c in n[2])


def _candidates(root: Element, paths: set[tuple[str, ...]], out: set[Element]) -> dict[str, list[Element]]:
    """Elements of a page by role, in page order: those on the wrapper's paths, and those deeper than the wrapper is."""
    roles: dict[str, list[Element]] = {"article": [], "main": [], "marked": []}
    longest = max(map(len, paths), default=0)
    stack: list[tuple[Element, tuple[str, ...] | None]] = [(root, ())]
    while stack:
        e, path = stack.pop()
        if e is not root and (e in out or outside(e, False)):
            continue
        # Paths are kept only as deep as the wrapper is.
        here = (*path, e.kind) if path is not None and len(path) <= max(longest, LEVELS) else None
        if here is None or here in paths:
            role = e.name if e.name in ("article", "main") else "marked" if e.marks & HOLDING else None
            if role:
                roles[role].append(e)
        stack += [(c, here) for c in reversed(e.children) if not isinstance(c, str)]
    return roles


def _holder(root: Element, out: set[Element]) -> list[Element]:
    """Without a known container: the lowest element that holds all text outside of what is marked."""
    order = [root]
    for e in order:
        order += [c for c in e.children if not isinstance(c, str) and c not in out and not outside(c, False)]
    size: dict[Element, int] = {}
    # Every element comes after the one that holds it.
    for e in reversed(order):
        size[e] = sum(len(c.strip()) if isinstance(c, str) else size.get(c, 0) for c in e.children)
    here, whole = root, size[root]
    while whole:
        inner = [c for c in here.children if not isinstance(c, str) and c.name in BLOCKS and size.get(c, 0) == whole]
        if not inner or inner[0].name in ("p", "pre"):
            break
        here = inner[0]
    return [here]


def _in_sentence(c: Element, holder: Element) -> bool:
    """A button named in a sentence is a part of it."""
    return c.name == "button" and holder.name in SENTENCES and any(isinstance(t, str) and t.strip() for t in holder.children)


def blocks(e: Element, out: set[Element]) -> list[tuple[Element, str]]:
    """(block element, text) inside an element in page order, white space as one blank, references decoded."""
    found: list[tuple[Element, str]] = []
    part: list[str] = []

    def close(holder: Element) -> None:
        text = " ".join(html.unescape("".join(part)).split())
        if text:
            found.append((holder, text))
        part.clear()

    # Open elements, what is left of their children, and their block.  Pages may be nested deeper than calls may be.
    stack = [(e, iter(e.children), e)]
    while stack:
        here, rest, block = stack[-1]
        for c in rest:
            if isinstance(c, str):
                part.append(c)
            elif c.name == "br":
                part.append("\n")
            elif (c in out or outside(c, True)) and not _in_sentence(c, here):
                close(block)
            else:
                if c.name in BLOCKS:
                    close(block)
                stack.append((c, iter(c.children), c if c.name in BLOCKS else block))
                break
        else:
            stack.pop()
            if here is block:
                close(block)
    return found


def _outermost(root: Element, found: list[Element]) -> list[Element]:
    """``found`` in page order; elements inside another one are read with it."""
    wanted, out, stack = set(found), [], [root] if found else []
    while stack:
        e = stack.pop()
        if e in wanted:
            out.append(e)
        else:
            stack += [c for c in reversed(e.children) if not isinstance(c, str)]
    return out


def _slot_names(root: Element) -> dict[Element, int]:
    """Name of every element's slot: the hash of the kinds from the page down to it."""
    names = {root: 0}
    stack = [root]
    while stack:
        e = stack.pop()
        for c in e.children:
            if not isinstance(c, str):
                names[c] = xxhash.xxh64_intdigest(c.kind, seed=names[e])
                stack.append(c)
    return names


def _filled(slot: int, text: str) -> int:
    """A slot with its text, as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=slot)
    return h - (1 << 64) if h >> 63 else h


def slots(root: Element) -> Iterator[tuple[int, int]]:
    """(slot with its text, page) for every different block of a page.

    A page counts as different by its longest block, and for that block by the next one, so that copies and near copies of one article count once.
    """
    names = _slot_names(root)
    found = {_filled(names[e], text): len(text) for e, text in blocks(root, hinted_out(root)) if e.name not in HEADINGS}
    order = sorted(found, key=lambda f: (-found[f], f))
    for f in order:
        yield f, next((o for o in order[:2] if o != f), 0)


def read_page(page: str | None, paths: list[tuple[str, ...]], template: frozenset[int] = frozenset()) -> str:
    """Main text of a page through its host's article paths, without its host's template texts."""
    root = parse(page or "")
    out = hinted_out(root)
    # A page is read through the first role that it has; a host may have several templates.
    roles = _candidates(root, set(paths), out)
    holders = _outermost(root, roles["article"] or roles["main"] or roles["marked"]) or _holder(root, out)
    found = [b for e in holders for b in blocks(e, out)]
    if template:
        names = _slot_names(root)
        own = [(e, text) for e, text in found if e.name in HEADINGS or _filled(names[e], text) not in template]
        # What is most of a page is no template.
        if 2 * sum(len(text) for _, text in own) >= sum(len(text) for _, text in found):
            found = own
    return "\n".join(text for _, text in found)


def _streams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page a row with its skeleton, and rows of its filled slots."""
    for frame in frames:
        for start in range(0, len(frame), 256):
            rows = []
            for h, p in zip(frame["host"].iloc[start : start + 256], frame["html"].iloc[start : start + 256], strict=True):
                root = parse(p or "")
                found = list(slots(root))
                rows.append((h, json.dumps(skeleton(root), separators=(",", ":")), None, found[0][0] if found else 0))
                rows += [(h, None, f, name) for f, name in found]
            hosts, skeletons, filled, names = zip(*rows, strict=True) if rows else ((),) * 4
            yield pd.DataFrame({"host": hosts, "skeleton": skeletons, "filled": pd.array(filled, dtype="Int64"), "page": pd.array(names, dtype="int64")})


def _one_wrapper(frame: pd.DataFrame) -> pd.DataFrame:
    found = json.dumps(wrapper(iter(sorted(frame["skeleton"]))), separators=(",", ":"))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "skeleton": [found]})


def host(url):
    """Host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def aligned(skeletons: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of (host, skeleton): groups of about ``GROUP_ROWS`` are aligned in each round, until a host has one."""
    level = settle(skeletons.distinct())
    while True:
        largest = level.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if largest <= 1:
            return level.withColumnRenamed("skeleton", "wrapper")
        salt = F.pmod(F.xxhash64("skeleton"), F.lit(-(-largest // GROUP_ROWS)))
        level = settle(level.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(_one_wrapper, "host string, skeleton string"))


def templates(streams: DataFrame) -> DataFrame:
    """host, template: the filled slots (numbers, by commas) that at least ``TEMPLATE_SHARE`` of a host's different pages have.

    A list is no longer than the blocks of a page over ``TEMPLATE_SHARE``.
    """
    pages = streams.where("skeleton IS NOT NULL").select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = streams.where("filled IS NOT NULL").select("host", "filled", "page").distinct().groupBy("host", "filled").agg(F.count(F.lit(1)).alias("n"))
    often = known.where(F.col("n") >= TEMPLATE_SHARE * TEMPLATE_PAGES).join(pages.where(F.col("pages") >= TEMPLATE_PAGES), "host")
    often = often.where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.col("filled").cast("string")))).alias("template"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), template (filled slots) of every host of ``pages``."""
    hosted = pages.select(host(pages["url"]).alias("host"), pages["html"].cast("string").alias("html"))
    streams = settle(hosted.mapInPandas(_streams, "host string, skeleton string, filled long, page long"))
    whole = aligned(streams.where("skeleton IS NOT NULL").select("host", "skeleton"))
    return whole.join(templates(streams), "host", "left").select("host", "wrapper", F.coalesce("template", F.lit("")).alias("template"))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[str, str], tuple[list[tuple[str, ...]], frozenset[int]]] = {}
    for frame in frames:
        texts = []
        for page, *w in zip(frame["html"], frame["wrapper"], frame["template"], strict=True):
            if tuple(w) not in known:
                if len(known) > 10_000:
                    known.clear()
                known[tuple(w)] = (article_paths(json.loads(w[0])) if w[0] else [], frozenset(map(int, w[1].split(","))) if w[1] else frozenset())
            texts.append(read_page(page, *known[tuple(w)]))
        frame["text"] = texts
        yield frame.drop(columns=["html", "wrapper", "template"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages``.

    Null or empty html gives the empty text; elements may be nested to any depth; a null url belongs to the host ''; rows that repeat give a row each;
    other columns are not read; an empty table gives no rows.
    """
    by_host = settle(wrappers(pages)).select(F.col("host").alias("w_host"), "wrapper", "template")
    hosted = pages.select("page_id", "url", pages["html"].cast("string").alias("html"), host(pages["url"]).alias("host"))
    rows = hosted.join(by_host, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", *[F.coalesce(c, F.lit("")).alias(c) for c in ("wrapper", "template")])
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return rows.mapInPandas(_read, f"page_id {kind['page_id']}, url {kind['url']}, text string")
