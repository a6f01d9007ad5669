"""HTML extraction with wrappers inferred as union-free regular expressions.

A page's token stream is nested by its tags and written as a pattern: a sequence of items, each
required, optional ("?") or repeated ("+"). Text blocks are items too; inline markup belongs to the
block around it. Siblings of text flow (paragraphs, headings, lists, bare text) that stand next to
each other become one repeated group of optional items, like neighbouring containers one repeated
item, and repeats of up to ``PERIOD`` of them one repeated group. Patterns of one host are aligned one after another: items
of the same tag whose contents are alike are merged (the heaviest common subsequence), and what only
one side has becomes optional. An item's text is constant as far as the same blocks stand there on
every page so far, and a slot otherwise. There are no alternatives, so a wrapper stays the size of a
template, not of its pages.

The wrapper, not a page, then decides what is text. Each item knows how many characters its slots,
constants and links hold over the host's pages:

* Constants go. Inside a declared or named article they prove nothing where they hold half of its text
  (copies), nor inside a declared one on a host with under ``SUPPORT`` pages.
* Elements that HTML itself gives another purpose (``nav``, ``form``, ``script`` and the like) go. If
  pages have an ``article`` or ``main`` element, only what is inside stays.
* Without one, lists of links go, and the search goes down from the root: as long as one container
  holds most of the slots, containers beside it with under ``BESIDE_SHARE`` of its text go (adverts,
  notices, comments on the host's template), unless they hold the heading.
* Class, id and role names break ties only: they drop what markup leaves open inside the text
  (``comments``), and they name the article where neither markup nor weight does.

A host whose pages are all the same has neither slots nor constants: all its text stays but that of
menus and the like. Each page is read by aligning it with its host's wrapper; a part that the wrapper
does not place is read like its parent, so texts stay whole.

Hosts are spread: each task aligns its own rows, partial wrappers of a host meet first in
``SALTS`` groups and then in one, so a host with a third of all pages costs a few wrappers a task.

Defined results. Null or empty html: empty text. A null or odd url: the empty host. Unclosed and
stray tags are closed as browsers do, as far as that matters for nesting; elements nested deeper than
``DEPTH`` become siblings at that depth, as in browsers. Repeated rows are read alike. Columns besides
page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, shipped, stored, unmasked

SALTS = 64
#: A task hands on its partial wrappers when it holds this many hosts.
HOSTS_HELD = 2_000
#: Wrappers are broadcast up to this many bytes in all, beyond it joined by shuffle.
BROADCAST_BYTES = 32 << 20
PERIOD = 3
#: Sequences of more items than this become one repeated group of optional items.
WIDE = 48
DEPTH = 200
#: Least likeness of two containers' contents for them to be one repeated item.
ALIKE = 0.5
#: Share of a container's text that makes one of its parts the way on, and the least text beside it.
MOST, BESIDE_SHARE = 0.5, 0.1
LINKED = 0.5
#: Pages from which on a constant inside a declared article is part of the template.
SUPPORT = 8
#: Stands for the page of a host with several distinct ones.
MANY = "many"

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu head".split()) | RAW
MAIN = frozenset("article main".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption hr address details summary #".split())
LISTS = frozenset("ul ol dl table".split())
# Names in class, id and role that mark parts beside the article, what may follow them after a hyphen, and names of the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies "
    "notice consent popup modal newsletter subscribe social share sharing related promo promoted sponsor sponsored comment comments reply replies "
    "disqus pagination pager toolbar login signup search".split()
)
PLACES = frozenset("area bar block body box button buttons container content form group holder inner item items left links list menu outer panel posts right section slot thread top unit widget wrap wrapper".split())
CENTRE = frozenset("article main content post entry story".split())
# A start tag closes an open element of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARTS = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[^a-zA-Z/!?])|[^<]+|<", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _hint(attributes: str) -> str:
    """"-" if a name marks a part beside the article, "+" if one marks the article."""
    if "=" not in attributes:
        return ""
    centre = False
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            first, *others = [w for w in re.split(r"[-_\d]+", name) if w] or [""]
            if first in BESIDE and PLACES.issuperset(others):
                return "-"
            centre = centre or first in CENTRE and PLACES.issuperset(others)
    return "+" if centre else ""


def parse(source: str | None) -> tuple[list, list]:
    """Nested page and its blocks. A node is [tag with hint, children], children being nodes or
    numbers of blocks; a block is (text, characters inside links)."""
    root: list = ["", []]
    blocks: list[tuple[str, int]] = []
    stack = [("", root)]  # inline elements are open under the node around them
    raw, held, linked, links, muted = None, [], 0, 0, None

    def flush() -> None:
        nonlocal held, linked, muted
        if held:
            text = " ".join("".join(held).split())
            if text:
                stack[-1][1][1].append(len(blocks))
                blocks.append((text, min(linked, len(text))))
            held = []
        linked, muted = 0, None

    def close(k: int) -> None:
        """Closes the open elements from number k on."""
        nonlocal links, muted
        if any(name not in INLINE for name, _ in stack[k:]):
            flush()
        links -= sum(name == "a" for name, _ in stack[k:])
        if muted is not None and muted >= k:
            muted = None
        del stack[k:]

    for m in _PARTS.finditer(source or ""):
        name = m[2]
        if name is None:
            whole = m[0]
            if raw is None and muted is None and not whole.startswith(("<!", "<?")):
                held.append(entities.unescape(whole))
                linked += len(whole) if links else 0
            continue
        tag = name.lower()
        if raw is not None:
            if m[1] and tag == raw:
                raw = None
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                raw = tag
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr" and muted is None:
                held.append(" ")
            continue
        if tag in CLOSES or tag not in INLINE:
            closed = CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1):
                at = stack[k][0]
                if at in closed:
                    close(k)
                    break
                if at not in INLINE:
                    break
        if m[3].endswith("/") and tag in INLINE:
            continue
        hint = _hint(m[3])
        if tag in INLINE:
            if len(stack) >= 2 * DEPTH:
                continue
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            if hint == "-" and muted is None:
                muted = len(stack) - 1
            continue
        flush()
        node = [tag + hint, []]
        stack[-1][1][1].append(node)
        if not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append((tag, node))
    flush()
    return root, blocks


# An item is [signature, flags, characters, of them in links, {hash of a constant: its length},
# items, numbers of blocks]. The signature is a tag with the hint of its names, "#" for a text block
# and "~" for a repeated group of optional items; numbers of blocks are of a page only.


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def page_of(page: tuple[list, list]) -> str:
    """A hash of what a page shows, "" for an empty page."""
    return _hash(json.dumps(page)) if page[0][1] else ""


def _one(a: str, b: str) -> str:
    """The page of two groups of pages: one that all of them are, or ``MANY``."""
    return a if a == b or not b else b if not a else MANY


def _tag(signature: str) -> str:
    return signature.rstrip("+-")


def pattern(page: tuple[list, list], node: list | None = None) -> list:
    """The item of a page (or of one of its nodes)."""
    root, blocks = page
    node = root if node is None else node
    items = []
    for child in node[1]:
        if isinstance(child, int):
            text, linked = blocks[child]
            items.append(["#", "", len(text), linked, {_hash(text): len(text)}, [], [child]])
        else:
            items.append(pattern(page, child))
    return [node[0], "", 0, 0, {}, _grouped(items), []]


def _grouped(items: list) -> list:
    """Neighbouring items of text flow as one group; repeated containers as one item."""
    out: list = []
    for item in items:
        if _tag(item[0]) in FLOW:
            if not out or out[-1][0] != "~":
                out.append(["~", "+", 0, 0, {}, [], []])
            _put(out[-1][5], item)
        else:
            out.append(item)
    return _folded(out)


def _put(group: list, item: list) -> None:
    """Adds an item of the same page to a group."""
    for other in group:
        if other[0] == item[0]:
            absorb(other, item)
            return
    group.append(item)


def contents(item: list) -> set[str]:
    found: set[str] = set()
    for child in item[5]:
        if child[0] == "~":
            found.update(c[0] for c in child[5])
        else:
            found.add(child[0])
    return found


def _alike(a: list, b: list) -> float:
    x, y = contents(a), contents(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def _folded(items: list) -> list:
    """Repeats become one repeated item, those of a group of siblings a group of optional items."""
    out: list = []
    for item in items:
        last = out[-1] if out else None
        if last and last[0] == "~" and (item[0] == "~" or item[0] in {i[0] for i in last[5]}):
            _absorb_into_group(last, item)
            continue
        out.append(item)
        for period in range(1, PERIOD + 1):
            if _repeats(out, period):
                if period == 1:
                    absorb(out[-2], out.pop())
                else:
                    out[-2 * period :] = [_mixed(out[-2 * period :])]
                break
    return out if len(out) <= WIDE else [_mixed(out)]


def _repeats(items: list, period: int) -> bool:
    """Whether the last ``period`` items are like those before them."""
    if len(items) < 2 * period:
        return False
    for a, b in zip(items[-2 * period : -period], items[-period:], strict=True):
        if a[0] != b[0] or a[0] != "~" and _alike(a, b) < ALIKE:
            return False
    return True


def _absorb_into_group(group: list, item: list) -> None:
    for part in item[5] if item[0] == "~" else [item]:
        _put(group[5], part)


def _mixed(items: list) -> list:
    """One repeated group of optional items, one for each signature."""
    group: list = ["~", "+", 0, 0, {}, [], []]
    for item in items:
        _absorb_into_group(group, item)
    return group


def _flags(a: str, b: str) -> str:
    return "".join(f for f in "?+" if f in a or f in b)


def absorb(a: list, b: list) -> None:
    """Makes ``a`` cover ``b``, which repeats it on the same page; both are used up."""
    a[1] = _flags(a[1] + "+", b[1])
    a[2], a[3] = a[2] + b[2], a[3] + b[3]
    a[4].update(b[4])
    a[6] += b[6]
    if a[0] == "~":
        _absorb_into_group(a, b)
        return
    items = []
    for i, j in aligned(a[5], b[5]):
        if i is None or j is None:
            one = i or j
            one[1] = _flags(one[1], "?")
            items.append(one)
        else:
            absorb(i, j)
            items.append(i)
    a[5] = items if len(items) <= WIDE else [_mixed(items)]


def merged(a: list, b: list) -> list:
    """The least pattern that covers both, which are of different pages: constant is what is so on
    both, and what only one has is optional and not constant."""
    if a[0] == "~":
        theirs = {i[0]: i for i in b[5]}
        items = []
        for i in a[5]:
            other = theirs.pop(i[0], None)
            items.append(_lone(i) if other is None else merged(i, other))
        for i in theirs.values():
            items.append(_lone(i))
    else:
        items = []
        for i, j in aligned(a[5], b[5]):
            items.append(_lone(i or j) if i is None or j is None else merged(i, j))
        if len(items) > WIDE:
            items = [_mixed(items)]
    return [a[0], _flags(a[1], b[1]), a[2] + b[2], a[3] + b[3], {h: n for h, n in a[4].items() if h in b[4]}, items, a[6] + b[6]]


def _lone(item: list) -> list:
    """An item that other pages lack."""
    items = []
    for i in item[5]:
        items.append(_lone(i))
    return [item[0], _flags(item[1], "?"), item[2], item[3], {}, items, item[6]]


def _copied(item: list) -> list:
    items = []
    for i in item[5]:
        items.append(_copied(i))
    return [*item[:4], dict(item[4]), items, item[6] if isinstance(item[6], bool) else list(item[6])]


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers or patterns of pages."""
    return merged(a, b)


def aligned(x: list, y: list) -> list[tuple]:
    """Pairs of items by the heaviest common subsequence of signatures, contents that are alike
    weighing more; None stands for what a side lacks."""
    if len(x) == len(y):
        same = True
        for i, j in zip(x, y, strict=True):
            same = same and i[0] == j[0] and (i[0] == "~" or _alike(i, j) > 0)
        if same:
            return list(zip(x, y, strict=True))
    # a group that took in all items of a sequence meets the items of the other
    if len(x) == 1 and x[0][0] == "~" and any(_tag(i[0]) not in FLOW for i in x[0][5]) and y:
        return [(x[0], _mixed([_copied(i) for i in y]))]
    if len(y) == 1 and y[0][0] == "~" and any(_tag(i[0]) not in FLOW for i in y[0][5]) and x:
        return [(_mixed([_copied(i) for i in x]), y[0])]
    n, m = len(x), len(y)
    weight = [[0.0 if i[0] != j[0] else 1 + 2 * _alike(i, j) for j in y] for i in x]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            both = best[i + 1][j + 1] + weight[i][j] if weight[i][j] else 0.0
            best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
    out: list[tuple] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i][j] == best[i + 1][j]:
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out


class Judge:
    """What the host's wrapper says of its items."""

    def __init__(self, wrapper: list, pages: int, alone: bool):
        self.pages, self.alone = max(1, pages), alone
        self.sums: dict[int, tuple[float, float, float]] = {}
        self.sum_up(wrapper)
        self.declared = self.any_with_text(wrapper, lambda i: _tag(i[0]) in MAIN)
        self.named = self.any_with_text(wrapper, lambda i: i[0].endswith("+"), aside=False)
        self.dropped: set[int] = set()
        self.centres: set[int] | None = None
        if not self.declared and (alone or not self.narrow(wrapper)) and self.named:
            self.centres = set()
            self.collect(wrapper)
        scoped = self.declared or self.centres is not None
        whole, constant = self.kept_text(wrapper, scoped, False)
        copies = scoped and 2 * constant >= whole
        self.constants = not (alone or copies or self.declared and self.pages < SUPPORT)

    def sum_up(self, item: list) -> tuple[float, float, float]:
        """(characters, of them constant, in links) of an item, a page."""
        chars, constant, links = float(item[2]) / self.pages, 0.0 if self.alone else float(sum(item[4].values())), float(item[3]) / self.pages
        for child in item[5]:
            a, b, c = self.sum_up(child)
            chars, constant, links = chars + a, constant + b, links + c
        self.sums[id(item)] = chars, constant, links
        return self.sums[id(item)]

    def mass(self, item: list) -> float:
        """Characters in slots, a page."""
        chars, constant, _ = self.sums[id(item)]
        return max(0.0, chars - constant)

    def any_with_text(self, item: list, fits, aside: bool = True) -> bool:
        for child in item[5]:
            if not aside and self.beside(child, False):
                continue
            if fits(child) and self.sums[id(child)][0] or self.any_with_text(child, fits, aside):
                return True
        return False

    def collect(self, item: list) -> None:
        for child in item[5]:
            if child[0].endswith("+"):
                self.centres.add(id(child))
            self.collect(child)

    def beside(self, item: list, inside: bool) -> bool:
        """Whether an item is no part of the text, by its markup or its names."""
        tag = _tag(item[0])
        if tag in MAIN:
            return False
        return tag in DROPPED or item[0].endswith("-") and tag not in ("html", "body") or tag == "header" and not inside

    def link_list(self, item: list) -> bool:
        chars, _, links = self.sums[id(item)]
        tag = _tag(item[0])
        return chars > 0 and links >= LINKED * chars and (tag in LISTS or tag not in FLOW and tag not in ("", "~", "html", "body"))

    def open_parts(self, item: list) -> list:
        return [i for i in item[5] if not self.beside(i, False) and not self.link_list(i)]

    def narrow(self, item: list) -> bool:
        """Goes down to where most of the slots are; what is light beside the way is dropped."""
        found, at = False, item
        while True:
            parts = self.open_parts(at)
            boxes = [i for i in parts if i[0] != "~"]
            steady = [i for i in boxes if "?" not in i[1]] or boxes
            heavy = max(steady, key=self.mass, default=None)
            if heavy is None or self.mass(heavy) < MOST * sum(self.mass(i) for i in parts if "?" not in i[1]) or not self.mass(heavy):
                return found
            for box in boxes:
                present = self.mass(box)
                if box is not heavy and present < BESIDE_SHARE * self.mass(heavy) and not self.heading(box):
                    self.dropped.add(id(box))
                    found = True
            if "+" in heavy[1]:
                return found
            at = heavy

    def heading(self, item: list) -> bool:
        return self.mass(item) > 0 and (_tag(item[0]) == "h1" or any(self.heading(i) for i in item[5]))

    def verdict(self, item: list, inside: bool, beside: bool) -> tuple[bool, bool]:
        """(inside, beside) of an item, given those of its parent."""
        main = _tag(item[0]) in MAIN if self.declared else self.centres is not None and id(item) in self.centres
        if main:
            return True, False  # an article inside an unclosed menu is still the article
        scoped = self.declared or self.centres is not None
        aside = beside or self.beside(item, inside) or id(item) in self.dropped or not scoped and self.link_list(item)
        return inside, aside

    def kept_text(self, item: list, scoped: bool, inside: bool, beside: bool = False) -> tuple[float, float]:
        kept = not beside and (inside or not scoped)
        whole, constant = (item[2] / self.pages, float(sum(item[4].values()))) if kept else (0.0, 0.0)
        for child in item[5]:
            now, aside = self.verdict(child, inside, beside)
            a, b = self.kept_text(child, scoped, now, aside)
            whole, constant = whole + a, constant + b
        return whole, constant

    def judged(self, item: list, inside: bool = False, beside: bool = False) -> list:
        """The wrapper as [signature, flags, 0, 0, constants that go, items, keep]: what a reader needs."""
        scoped = self.declared or self.centres is not None
        items = []
        for child in item[5]:
            items.append(self.judged(child, *self.verdict(child, inside, beside)))
        return [item[0], item[1], 0, 0, item[4] if self.constants else {}, items, not beside and (inside or not scoped)]


def judge(wrapper: list, pages: int = 2, alone: bool = False) -> list:
    """What a reader needs of a wrapper. ``alone`` says that the host has one distinct page."""
    return Judge(wrapper, pages, alone).judged(wrapper)


def read(page: tuple[list, list], judged: list) -> str:
    """The kept text of a page, by aligning its pattern with the wrapper's."""
    keep: set[int] = set()

    def lone(item: list, kept: bool) -> None:
        """A part that the wrapper does not place is read like its parent."""
        kept = kept and _tag(item[0]) not in DROPPED and not item[0].endswith("-")
        if kept:
            keep.update(item[6])
        for child in item[5]:
            lone(child, kept)

    def visit(own: list, at: list) -> None:
        if at[6]:
            for block in own[6]:
                if not at[4] or _hash(page[1][block][0]) not in at[4]:
                    keep.add(block)
        if own[0] == "~":
            known = {i[0]: i for i in at[5]}
            for child in own[5]:
                if child[0] in known:
                    visit(child, known[child[0]])
                else:
                    lone(child, at[6])
            return
        for child, other in aligned(own[5], at[5]):
            if child is not None and other is not None:
                visit(child, other)
            elif child is not None:
                lone(child, at[6])

    visit(pattern(page), judged)
    return " ".join(page[1][k][0] for k in sorted(keep))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, page, n) for every host, over all its pages that are not empty; page is ``MANY``
    if they differ, n counts them."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list, str, int]] = {}
        for frame in frames:
            for host, source in zip(frame["host"], frame["html"], strict=True):
                parsed = parse(source)
                page = page_of(parsed)
                if host not in held or not held[host][1]:
                    held[host] = _bare(pattern(parsed)), page, int(page != "")
                elif page:
                    wrapper, other, n = held[host]
                    held[host] = align(wrapper, _bare(pattern(parsed))), _one(other, page), n + 1
            if len(held) > HOSTS_HELD:
                yield _frame(held)
                held = {}
        if held:
            yield _frame(held)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in sorted(frame["wrapper"][frame["page"] != ""]) or frame["wrapper"][:1]:
            own = json.loads(text)
            total = own if total is None else align(total, own)
        return pd.DataFrame({"host": frame["host"][:1], "wrapper": [json.dumps(total)], "page": [reduce(_one, frame["page"])], "n": [frame["n"].sum()]})

    schema = "host string, wrapper string, page string, n bigint"
    parts = shipped(pages).select(host_of(F.col("url")).alias("host"), "html").mapInPandas(partial, schema)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    first = parts.groupBy("host", "salt").applyInPandas(lambda frame: meet(frame), schema)
    return first.groupBy("host").applyInPandas(lambda frame: meet(frame), schema)


def _bare(item: list) -> list:
    """An item without the numbers of its page's blocks."""
    return [*item[:5], [_bare(i) for i in item[5]], []]


def _frame(held: dict[str, tuple[list, str, int]]) -> pd.DataFrame:
    return pd.DataFrame({
        "host": list(held), "wrapper": [json.dumps(w) for w, _, _ in held.values()],
        "page": [p for _, p, _ in held.values()], "n": [n for _, _, n in held.values()],
    })


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    found = stored(wrappers(pages).select("host", "wrapper", (F.col("page") != MANY).alias("alone"), "n"))
    small = (found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(found) if small else found, "host", "left")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, bool, int], list] = {}
        for frame in frames:
            texts = []
            for source, *key in zip(frame["html"], frame["wrapper"], frame["alone"], frame["n"], strict=True):
                key = tuple(key)
                if key not in known:
                    if len(known) > HOSTS_HELD:
                        known.clear()
                    known[key] = judge(json.loads(key[0]), int(key[2]), bool(key[1]))
                texts.append(read(parse(source), known[key]))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts})

    rows = masked(shipped(rows).select("page_id", "url", "html", "wrapper", "alone", "n"), "page_id")
    texts = rows.mapInPandas(batches, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
    return unmasked(texts, "page_id", pages.schema["page_id"].dataType)
