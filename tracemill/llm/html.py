"""HTML extraction by equivalence-class template deduction.

Pages of a host are dealt to groups. In a group the tokens of a page are its tags and its runs of text,
each told apart by the path of open elements. Tokens with equal occurrence vectors over the group's pages
form equivalence classes; a class is valid if its tokens keep their order on all pages that hold them and
no class crosses another. The valid classes, nested, are the template; what it leaves between its tokens
are the slots. Regions are elements of the template: its articles, or else the narrowest element that
holds most of the text in slots. A region's slots are the main text, less those in page furniture; what
is furniture or an article is known by element, class and id names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pages that one template is deduced from at most; a larger host has several groups.
GROUP = 256
#: Hosts of several groups that are broadcast at most, of some 100 bytes each.
BROADCAST_HOSTS = 100_000
#: Different pages that must hold a run of text before it counts as template text.
LEAST_PAGES, LEAST_SHARE = 10, 0.9
#: Share of a group's text in slots that its widest region holds.
MOST = 0.9
#: The token that all pages have: the page itself.
PAGE = ("open", (), "page")
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|iframe|svg|math|textarea)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[^<]+|<""", re.S | re.I)
#: Element names, and the words in a class or id by which page furniture is known.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset("p".split())
BLOCKS_IN_P = frozenset("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr tbody thead tfoot".split())
FURNITURE = frozenset("nav header footer aside form head title button select option dialog menu".split())
MAIN = frozenset("article main".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|footer|foot|notice|cookies?|consent|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|replies|discussion|disqus)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokens_of(page: str) -> list:
    """(kind, path, value) of a page: kind "open", "shut" or "text"; path: the open elements' numbers in a trie are spelled as a tuple of labels."""
    out, stack = [], []
    for m in TOKEN.finditer(page):
        name = m[3]
        if name is None:
            piece = m[0]
            if m[1] or (piece[0] == "<" and len(piece) > 1):
                continue  # comments, scripts and declarations have no text
            out.append(("text", tuple(stack), piece))
            continue
        name = name.lower()
        if m[2]:
            if name in (x.split(".")[0] for x in stack):
                while True:
                    label = stack.pop()
                    if label.split(".")[0] == name:
                        break
                out.append(("shut", tuple(stack), name))
            elif name == "br" or name == "p":
                out.append(("shut", tuple(stack), name))
            continue
        label = name
        marks = " ".join(x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(m[4]) if x[0].lower() in ("class", "id", "role"))
        if marks:
            label = f"{name}.{' '.join(marks.split())}"
        if name in BLOCKS_IN_P:  # a block ends an open paragraph, and a list item or cell its like
            for open_ in ("p", *((name,) if name in ("li", "dt", "dd", "td", "th", "tr", "option") else ())):
                names = [x.split(".")[0] for x in stack]
                if open_ in names and not any(x in ("ul", "ol", "table", "article", "section", "div", "aside", "nav") for x in names[len(names) - names[::-1].index(open_) :]):
                    del stack[len(names) - 1 - names[::-1].index(open_) :]
        out.append(("open", tuple(stack), label))
        if name not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(label)
    return out


def furniture(path: tuple) -> bool:
    """Whether a path of open elements runs through page furniture."""
    return any(x.split(".")[0] in FURNITURE or ("." in x and MARKS.search(x.split(".", 1)[1])) for x in path)


def in_main(path: tuple) -> bool:
    return any(x.split(".")[0] in MAIN or ".main" in x or " main" in x for x in path)


def template(pages: list, least_text: int = 2) -> set:
    """Tokens of the valid equivalence classes of pages, each a list of tokens; text only of at least `least_text` pages. One page alone has no template text."""
    where = [defaultdict(list) for _ in pages]
    for held, page in zip(where, pages, strict=True):
        for i, t in enumerate(page):
            held[t].append(i)
    pages_of: dict = defaultdict(list)
    for k, held in enumerate(where):
        for t, at in held.items():
            pages_of[t].append((k, len(at)))
    classes: dict = defaultdict(list)
    least = min(2, len(pages))
    for t, vector in pages_of.items():
        if len(vector) >= (least if t[0] != "text" else least_text):
            classes[tuple(vector)].append(t)
    valid = []
    for vector, own in classes.items():
        k, n = vector[0]
        own.sort(key=lambda t: where[k][t][0])
        tags = [t for t in own if t[0] != "text"]
        if len(tags) < len(own) and len(vector) < len(pages) and not tags:
            continue  # text that some pages lack and that brings no tag of its own is no part of the template
        for some in (own, tags):  # text that moves about does not unmake the class of the tags
            if some and all(ordered([where[k][t] for t in some]) for k, _ in vector):
                valid.append((len(vector), len(some), vector, some))
                break
    valid.sort(key=lambda x: (-x[0], -x[1]))
    out: set = set()
    kept: list = []
    for _, _, vector, own in valid:
        k = vector[0][0]
        spans = spans_of([where[k][t] for t in own])
        if all(nests(spans, other[k]) for other in kept if k in other):
            kept.append({k: spans})
            out.update(own)
    return (out if len(pages) > 1 else {t for t in out if t[0] != "text"}) | {PAGE}


def ordered(places: list) -> bool:
    """Whether tokens with equally many places each come in turn, round by round."""
    flat = [x for turn in zip(*places, strict=False) for x in turn]
    return all(a < b for a, b in zip(flat, flat[1:], strict=False))


def spans_of(places: list) -> list:
    return [(turn[0], turn[-1]) for turn in zip(*places, strict=False)]


def nests(own: list, other: list) -> bool:
    """Whether no span of one list crosses one of the other."""
    edges = sorted([(a, 0, b) for a, b in own] + [(a, 1, b) for a, b in other])
    open_: list = []
    for a, kind, b in edges:
        while open_ and open_[-1][0] < a:
            open_.pop()
        if open_ and open_[-1][1] != kind and b > open_[-1][0]:
            return False
        open_.append((b, kind))
    return True


def body(page: list) -> tuple:
    """A page's texts in its article, or else outside furniture, without blanks."""
    article = any(in_main(path) for kind, path, _ in page if kind == "text")
    return tuple(t for t in page if t[0] == "text" and t[2].strip() and not furniture(t[1]) and (not article or in_main(t[1])))


def distinct(pages: list) -> list:
    """One page of each different body: copies of a page are one page to the template. Pages without a body are left out."""
    first: dict = {}
    for page in pages:
        own = body(page)
        if own:
            first.setdefault(own, page)
    return list(first.values())


def spread(n: int) -> int:
    """Of how many of n different pages a text must be before it can be template text: of a few pages all."""
    return math.ceil(LEAST_SHARE * n) if n >= LEAST_PAGES else max(n, 3)


def without_copies(shape: set, pages: list) -> set:
    """`shape` of fewer than LEAST_PAGES different pages, less its text if that is half of any page's body: such pages are near copies."""
    for page in pages if len(pages) < LEAST_PAGES else ():
        own = body(page)
        if 2 * sum(len(t[2]) for t in own if t in shape) >= sum(len(t[2]) for t in own):
            return {t for t in shape if t[0] != "text"}
    return shape


def elements(path: tuple):
    """The tokens that open the elements of a path, from the outermost, and the paths down to them."""
    for n in range(len(path)):
        yield ("open", path[:n], path[n]), path[: n + 1]


def regions(pages: list, shape: set) -> list:
    """Paths of the template's elements that hold main text: articles, and the narrowest that holds most of the text of slots outside furniture.

    Only elements whose opening tags are in the template count, so what no class holds is no region.
    """
    sizes: Counter = Counter()
    main, total = set(), 0
    for page in pages:
        for t in page:
            if t[0] != "text" or t in shape or furniture(t[1]) or not t[2].strip():
                continue
            total += len(t[2])
            for tag, path in elements(t[1]):
                if tag in shape:
                    sizes[path] += len(t[2])
                    if in_main(path[-1:]):
                        main.add(path)
    wide = [path for path, n in sizes.items() if n >= MOST * total]
    return [main, max(wide, key=len) if wide else ()]


def extract(pages: list) -> list:
    """The main text of each of the pages of one host (html strings)."""
    tokens = [tokens_of(p) for p in pages]
    own = distinct(tokens)
    shape = without_copies(template(own, spread(len(own))), own)
    shape |= template_of_rest(tokens, shape)
    main, wide = regions(own, shape)
    return [main_text(page, shape, main, wide) for page in tokens]


def template_of_rest(pages: list, shape: set) -> set:
    """Tags of the articles of pages that the template lacks: such a page is deduced alone, as it shares no class with others."""
    out: set = set()
    for page in pages:
        tags = {t for t in page if t[0] == "open" and in_main((t[2],))}
        if tags and not tags & shape:
            out |= template([page]) & tags
    return out


def main_text(page: list, shape: set, main: set, wide: tuple) -> str:
    """The slots of the page in the template's regions: in its articles, else in its widest region, else, on a page without that, outside furniture. Blocks end at tags that are not inline."""
    if not shape:
        return ""
    inside = [[path for _, path in elements(t[1])] if t[0] == "text" else [] for t in page]
    some = [bool(t) and any(p in main for p in t) for t in inside]
    if not any(some):
        some = [wide in t for t in inside] if wide and any(wide in t for t in inside) else [t[0] == "text" for t in page]
    blocks, line = [], []
    for t, own in zip(page, some, strict=True):
        kind, path, value = t
        if kind != "text":
            if value.split(".")[0] not in INLINE:
                blocks.append("".join(line))
                line = []
        elif own and not furniture(path) and t not in shape:
            line.append(entities.unescape(value))
    blocks.append("".join(line))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """(id, url, text, n_chars): one row per input row.

    Pages without a url share a host of their own; null and empty pages have an empty text. Repeated rows
    are pages of their own. An empty table gives none. A host's pages are dealt by a hash of url and id to
    groups of about `group` pages, so a large host is never gathered in one task.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("host", F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    large = cut(own.groupBy("host").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")).where("groups > 1"))
    near = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    dealt = own.join(near, "host", "left").withColumn("part", F.pmod(F.xxhash64("url", "page_id"), F.coalesce("groups", F.lit(1)))).repartition("host", "part")

    def run(pdf):
        pdf = pdf.sort_values(["page_id"], kind="stable")
        texts = extract([x or "" for x in pdf["html"]])
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    out = dealt.groupBy("host", "part").applyInPandas(run, "page_id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
