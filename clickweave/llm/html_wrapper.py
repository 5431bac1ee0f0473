"""HTML extraction: union-free regular-expression inference of page wrappers, and main text by their slots.

A page is a stream of tags and texts. Repeated stretches of the stream are folded into repeated groups; then the folded streams of a host's
pages are aligned one after the other, and what only some of them have becomes optional. The result is a union-free
regular expression of tags, text slots, optional nodes and repeated groups: the host's wrapper. The wrapper decides in two ways:

- A slot that has one and the same text on `LEAST_PAGES` different pages or more, and no other text on any page, is template: on a page without
  article or main element, a block is left out if all its texts align with such slots. Inside an article it stays, as headings that all articles share do. Near copies of one page don't make its text template:
  pages count as different for a text only if their two longest other texts outside noise differ.
- Slots gather the characters outside links that they have on all pages, template apart. The innermost container of the wrapper, outside
  repeated groups, that holds `SHARE` of these is the host's main part. On a page without article or main element, texts that align with slots outside
  of it are left out, however its classes are named: menus, lists of links, side columns and footers that change from page to page.
  Varying titles (h1) count as inside.

A slot's key has the label of what encloses it on the page: main text inside the article, noise inside menus, headers, footers, sidebars,
notices, adverts, forms and comments, by element, role, or a class or id that names such a thing. A name does so by its head word:
`reader-comments`, `comment-list` and `comments-open` do; `notice-period` and `share-prices` don't, nor do names of a state such as `no-sidebar`.
A name alone doesn't decide where other evidence speaks: what encloses or is the page's main heading or article isn't noise, and on elements of text (paragraphs, headings,
items, spans) the words that subjects have too (`DOUBTED`) make a text doubtful. It is left out if it is a link's, or if its slot in the wrapper is template; else it stays.

All pages take part. A task merges the pages that it reads into one wrapper for each host, and these are merged `FAN` at a time in as many rounds as
it takes, so a hot host is never one task's. A wrapper has at most `LONGEST` optional nodes: beyond them, the half that came up most often is kept, as in
lossy counting, so what many pages have stays and a host of any number of pages that are all different has a bounded wrapper. Streams are aligned by
blocks of `LONGEST` nodes; longer ones first by keys that both have once, in order, and what is between them in pieces, so the time is linear in
the nodes. Stretches of over `PERIOD` nodes aren't folded, which makes a wrapper longer and loses no text. Texts that align with no slot of the
wrapper, also as theirs wasn't kept, have the label that the page's own tags give.

Defined results: null or empty html gives an empty text; character references are decoded, white space in a block becomes one
blank, blocks are joined by a line break in page order; tags may be left open or closed in the wrong order; repeated
rows give repeated rows; an empty table gives an empty table; columns of any other names pass; pages without a host share a wrapper.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape
from itertools import accumulate, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest, xxh64_intdigest

from .common import Rows, broadcastable, discard, join_small, stored, table
from .url_filter import split_url

#: Longest repeated stretch that is folded; nodes of a folded stream that are aligned at once; nodes that a task holds at once.
PERIOD, LONGEST, HELD = 64, 4096, 400_000
#: Nodes of a side up to which streams are compared node by node; wrappers that are merged at once.
PIECE, FAN = 256, 64
#: Share of a host's characters outside links that its main part has.
SHARE = 0.85
#: Different pages that a text must be on to be template.
LEAST_PAGES = 4

#: Element names and words of class or id.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
NOISE = set("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
NOISE_WORDS = set(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words of noise that texts are about or that style them as well.
DOUBTED = set("alert banner header login menu notice notices overlay related search share social toolbar widget".split())
#: Elements that hold text and no parts of a page.
TEXTUAL = set("a b blockquote cite code dd dt em figcaption font h1 h2 h3 h4 h5 h6 i label li mark p pre q small span strong td th".split())
#: Words of a name that say only which part of a thing an element is.
PARTS = set("a area articles author bar body bottom box btn button buttons center col column container content count date entry group heading icon icons image inner item items label left link links list main menu meta outer panel posts right row section slot stories text thread title top wrap wrapper".split())
#: Words that make a name a state or a subject, not a thing.
STATES = set("active category closed enabled disabled format has hide is no non not off on open show status tag tags topic with without".split())
NOISE_ROLES = set("banner complementary contentinfo navigation search form alert dialog".split())
MAIN = {"article", "main"}
CONTAINERS = set("body center div main section td".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:.-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:.-]*)([^>]*)>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NAME = re.compile(r"[^!?.#]+")


#: How an element encloses noise: not at all, perhaps, by its name, by its tag, role or being hidden.
NOT, DOUBT, NAMED, SURE = range(4)


def noise_word(name: str, states_end: bool = False) -> str | None:
    """The word by which a class or id names something that isn't main text; a state at its start makes it none, one at its end only if `states_end`."""
    words = [w.lower() for w in WORD.findall(name)]
    while len(words) > 1 and (words[-1] in PARTS or not states_end and words[-1] in STATES):
        words.pop()
    return words[-1] if words and words[-1] in NOISE_WORDS and not STATES & set(words) else None


@lru_cache(4096)
def opened(name: str, attributes: str) -> tuple[str, int]:
    """Key of an opening tag, which tells its noise and all of its class and id; and whether it encloses noise: NOT, DOUBT, NAMED or SURE."""
    named: list[str] = []
    sure, shown = name in NOISE, ""
    for a, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if (a := a.lower()) == "role":
            sure |= value.lower() in NOISE_ROLES
        elif a == "hidden":
            sure |= not value or value.lower() == "hidden"
        elif a in ("class", "id"):
            named += value.split()
            shown += ("." if a == "class" else "#") + re.sub(r"\d+", "9", value)
    noise = SURE if sure else NOT
    if not sure and name not in ("html", "body", "main"):
        words = {w for x in named if (w := noise_word(x, name in MAIN))}
        noise = NOT if not words else DOUBT if name in TEXTUAL and words <= DOUBTED else NAMED
    if len(shown) > 80:
        shown = f"{shown[:64]}~{xxh64_hexdigest(shown.encode('utf-8', 'surrogatepass'))}"
    return name + ("", "?", "!", "!")[noise] + shown, noise


def events(html: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text `#`, opening `<` and closing `>`."""
    out, at = [], 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            out.append(("#", html[at : m.start()], ""))
        at = m.end()
        if m[3] or m[6]:
            name = (m[3] or m[6]).lower()
            out.append((">" if m[2] or m[5] else "<", name, m[4] or m[7] or ""))
    if at < len(html):
        out.append(("#", html[at:], ""))
    return out


class Regions:
    """What encloses the place in a stream of tags: noise, something doubtful, an article, or neither."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.names: Counter = Counter()
        self.noise = self.doubt = self.main = 0
        self.any_main = False

    def open(self, name: str, how: int) -> None:
        if name in VOID:
            return
        noise, doubt = how >= NAMED, how == DOUBT
        main = name in MAIN and not noise and not self.noise
        self.stack.append((name, noise, doubt, main))
        self.names[name] += 1
        self.noise += noise
        self.doubt += doubt
        self.main += main
        self.any_main |= main

    def close(self, name: str) -> None:
        if not self.names[name]:
            return
        while True:
            x, noise, doubt, main = self.stack.pop()
            self.names[x] -= 1
            self.noise -= noise
            self.doubt -= doubt
            self.main -= main
            if x == name:
                return

    def label(self) -> int:
        """0 noise, 1 neither, 2 main; 3 and 4 are doubtful 1 and 2."""
        return 0 if self.noise else (2 if self.main else 1) + 2 * (self.doubt > 0)


def spared(found: list[tuple[str, str, str]]) -> set[int]:
    """The tags that are named as noise and yet enclose the page's first main heading, or an article, of their own."""
    out, stack, names = set(), [], Counter()
    heading = False
    for i, (kind, x, attributes) in enumerate(found):
        if kind == "<" and x not in VOID:
            how = opened(x, attributes)[1]
            first = x == "h1" and not heading and how < NAMED and not any(h == SURE for *_, h in stack)
            heading |= first
            if first or (x in MAIN and how == NOT):
                out.update(at for _, at, h in stack if h == NAMED)
            stack.append((x, i, how))
            names[x] += 1
        elif kind == ">" and names[x]:
            while True:
                y, *_ = stack.pop()
                names[y] -= 1
                if y == x:
                    break
    return out


# A node of a wrapper is [key, optional, body, texts, times]: key is an opening tag's, `/` and the key of what a closing tag closes, `#` and the label of a text
# slot, or `+` and the first key of a repeated group; body are the nodes of a group; texts are the numbers of a page's texts at a slot,
# in a host's wrapper [[hash of its one text or null, hashes that tell LEAST_PAGES of its pages apart, characters outside links]], and a
# (template, outside the main part) pair when it is used; times is how often it came up.
# As a slot's key has its label, texts that noise encloses on one page never share a slot with main text of another.


def node(key: str, texts: Iterable[int] = ()) -> list:
    return [key, False, None, list(texts), 1]


KEY, OPTIONAL, BODY, TEXTS, TIMES = range(5)


def own_labels(found: list[tuple[str, str, str]]) -> tuple[list[int], bool, set[int]]:
    """The label of every text by the page's own tags (-1 for tags), whether there is an article, and the texts of links."""
    regions, own, linked, spare = Regions(), [], set(), spared(found)
    for i, (kind, x, attributes) in enumerate(found):
        if kind == "<":
            regions.open(x, NOT if i in spare else opened(x, attributes)[1])
        elif kind == ">":
            regions.close(x)
        elif regions.names["a"]:
            linked.add(i)
        own.append(regions.label() if kind == "#" else -1)
    return own, regions.any_main, linked


def stream(found: list[tuple[str, str, str]], own: list[int]) -> list[list]:
    out, stack, names = [], [], Counter()
    for i, (kind, x, attributes) in enumerate(found):
        if kind == "#":
            if x.strip():
                out.append(node(f"#{own[i]}", [i]))
        elif kind == "<":
            out.append(node(key := opened(x, attributes)[0]))
            if x not in VOID:
                stack.append((x, key))
                names[x] += 1
        elif not names[x]:
            out.append(node("/" + x))
        else:
            while True:
                y, key = stack.pop()
                names[y] -= 1
                if y == x:
                    break
            out.append(node("/" + key))
    return out


def keys(nodes: list[list]) -> list[str]:
    return [n[KEY] for n in nodes]


Stretch = tuple[bool, int, int, int, int]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in order of their first places, whose second places rise."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, place) in enumerate(pairs):
        k = bisect_left(ends, place)
        ends[k : k + 1], at[k : k + 1] = [place], [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def compared(a: tuple, b: tuple, depth: int = 0) -> list[Stretch]:
    """Stretches of an alignment in time that is linear in long streams: by keys that both have once, then in pieces."""
    if not a or not b:
        return [(False, 0, len(a), 0, len(b))]
    if len(a) * len(b) <= PIECE * PIECE:
        return [(kind == "equal", *places) for kind, *places in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
    cuts: list[tuple[int, int, int]] = []  # places in a and in b, and the length of what is equal from there on
    if depth < 4:
        once_a, once_b = ({x for x, n in Counter(keys_).items() if n == 1} for keys_ in (a, b))
        place = {x: k for k, x in enumerate(b) if x in once_a and x in once_b}
        cuts = [(i, k, 1) for i, k in rising([(i, place[x]) for i, x in enumerate(a) if x in place])]
    if not cuts:
        n = math.ceil(max(len(a), len(b)) / PIECE)
        cuts, depth = [(i * len(a) // n, i * len(b) // n, 0) for i in range(1, n)], 4
    out: list[Stretch] = []
    i = k = 0
    for j, l, equal in [*cuts, (len(a), len(b), 0)]:
        if i < j or k < l:
            out += [(same, i + w, i + x, k + y, k + z) for same, w, x, y, z in compared(a[i:j], b[k:l], depth)]
        out += [(True, j, j + 1, l, l + 1)] if equal else []
        i, k = j + equal, l + equal
    return out


def matched(a: tuple, b: tuple) -> list[Stretch]:
    """Stretches (equal or not, from and to in a, from and to in b) of an alignment; what both begin and end with is equal."""
    most = min(len(a), len(b))
    start = next((i for i in range(most) if a[i] != b[i]), most)
    end = next((i for i in range(most - start) if a[-1 - i] != b[-1 - i]), most - start)
    inner = compared(a[start : len(a) - end], b[start : len(b) - end]) if start + end < max(len(a), len(b)) else []
    out = [(True, 0, start, 0, start)] + [(same, i + start, j + start, k + start, l + start) for same, i, j, k, l in inner]
    return [*out, (True, len(a) - end, len(a), len(b) - end, len(b))]


short_matched = lru_cache(1 << 13)(matched)


def align(a: list[list], b: list[list]) -> list[list]:
    """The two streams as one: what both have, and the rest as optional."""
    ka, kb = keys(a), keys(b)
    if ka == kb:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    a, b = regrouped(a, b), regrouped(b, a)
    out: list[list] = []
    match = short_matched if len(a) + len(b) <= 256 else matched  # the same stretches come again and again
    for equal, i, j, k, l in match(tuple(keys(a)), tuple(keys(b))):
        if equal:
            out += [merged(x, y) for x, y in zip(a[i:j], b[k:l], strict=True)]
        else:
            out += [[n[KEY], True, n[BODY], n[TEXTS], n[TIMES]] for n in a[i:j] + b[k:l]]
    return out


def merged(x: list, y: list) -> list:
    return [x[KEY], x[OPTIONAL] or y[OPTIONAL], align(x[BODY], y[BODY]) if x[BODY] is not None else None, united(x[TEXTS], y[TEXTS]), x[TIMES] + y[TIMES]]


def united(x: list, y: list) -> list:
    """The texts of a merged slot: a page's numbers together, and two slots' evidence as one."""
    if not (x and y and isinstance(x[0], list) and isinstance(y[0], list)):
        return x + y
    (one, pages, mass), (other, more, added) = x[0], y[0]
    return [[one, sorted({*pages, *more})[:LEAST_PAGES], mass + added]] if one == other and one is not None else [[None, [], mass + added]]


def alike(a: list[list], b: list[list]) -> bool:
    """Whether two stretches are repetitions of one group: at least half of the shorter is common."""
    ka, kb = keys(a), keys(b)
    return ka == kb or (ka[0] == kb[0] and sum((Counter(ka) & Counter(kb)).values()) * 2 > min(len(ka), len(kb)))


def group(body: list[list]) -> list:
    return ["+" + body[0][KEY], False, body, [], 1]


def covers(body: list[list], nodes: list[list], at: int) -> int:
    """Length of the stretch at `at` that the group's body matches, or 0."""
    i = at
    for n in body:
        if i < len(nodes) and nodes[i][KEY] == n[KEY]:
            i += 1
        elif not n[OPTIONAL]:
            return 0
    return i - at


def regrouped(nodes: list[list], other: list[list]) -> list[list]:
    """`nodes` with single occurrences of groups that the other stream repeats made groups too."""
    mine = set(keys(nodes))
    bodies = {n[BODY][0][KEY]: n[BODY] for n in other if n[BODY] is not None and n[KEY] not in mine}
    if not bodies:
        return nodes
    out, i = [], 0
    while i < len(nodes):
        n = covers(bodies[nodes[i][KEY]], nodes, i) if nodes[i][KEY] in bodies else 0
        out.append(group(nodes[i : i + n]) if n > 1 else nodes[i])
        i += max(1, n if n > 1 else 1)
    return out


def fold(nodes: list[list]) -> list[list]:
    """A stream with its repeated stretches as groups; neighbouring stretches may differ in optional nodes."""
    out: list[list] = []
    last: dict[str, list[int]] = {}  # places of each opening key in `out`
    for n in nodes:
        key = n[KEY]
        if key[0] not in "#/+":
            places = last.setdefault(key, [])
            while places and places[-1] >= len(out):
                places.pop()
            if places and len(out) - places[-1] <= PERIOD and out[places[-1]][KEY] == key:
                j = places[-1]
                chunk, before = out[j:], out[j - 1] if j else None
                if before is not None and before[KEY] == "+" + key and alike(before[BODY], chunk):
                    out[j - 1] = group(align(before[BODY], chunk))
                    del out[j:]
                    places.pop()
                elif len(places) > 1 and j - places[-2] <= PERIOD and out[places[-2]][KEY] == key and alike(out[places[-2] : j], chunk):
                    i = places[-2]
                    out[i:] = [group(align(out[i:j], chunk))]
                    del places[-2:]
            places.append(len(out))
        out.append(n)
    i = 0
    while i + 1 < len(out):  # the last repetition, which nothing like it follows
        n = covers(out[i][BODY], out, i + 1) if out[i][BODY] is not None else 0
        if n:
            out[i] = group(align(out[i][BODY], out[i + 1 : i + 1 + n]))
            del out[i + 1 : i + 1 + n]
        else:
            i += 1
    return out


def digest(text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def witnessed(nodes: list[list], found: list[tuple[str, str, str]], own: list[int], linked: set[int]) -> list[list]:
    """A page's nodes with evidence in place of the numbers of its texts."""
    shown = {i: " ".join(x.split()) for i, (kind, x, _) in enumerate(found) if kind == "#"}
    longest = sorted({x for i, x in shown.items() if own[i] in (1, 2)}, key=lambda x: (-len(x), x))[:3]

    def evidence(texts: list[int]) -> list:
        mass = sum(len(shown[i]) for i in texts if own[i] in (1, 2) and i not in linked)
        if len(kinds := {shown[i] for i in texts}) > 1:
            return [[None, [], mass]]
        (one,) = kinds
        return [[digest(one), [digest("\n".join([x for x in longest if x != one][:2]))], mass]]

    def walk(part: list[list]) -> list[list]:
        return [[k, opt, None if body is None else walk(body), evidence(texts) if texts else [], times] for k, opt, body, texts, times in part]

    return walk(nodes)


def shape(nodes: list[list]) -> tuple:
    return tuple((k, opt, None if body is None else shape(body)) for k, opt, body, _, _ in nodes)


def size(nodes: list[list]) -> int:
    return sum(1 if n[BODY] is None else 1 + size(n[BODY]) for n in nodes)


def is_template(n: list) -> bool:
    return bool(n[TEXTS]) and n[TEXTS][0][0] is not None and len(n[TEXTS][0][1]) >= LEAST_PAGES


def mass_of(n: list) -> int:
    """Characters outside links, template apart, of a node."""
    if n[BODY] is not None:
        return sum(map(mass_of, n[BODY]))
    return n[TEXTS][0][2] if n[TEXTS] and not is_template(n) else 0


def main_part(nodes: list[list]) -> tuple[int, int]:
    """Where the innermost container with `SHARE` of all characters, of those that half of the pages have, starts and ends; everything if there are none."""
    masses = [mass_of(n) for n in nodes]
    before = list(accumulate(masses, initial=0))
    best, stack = (0, len(nodes)), []

    def closed(start: int, end: int) -> None:
        nonlocal best
        if before[end] - before[start] >= SHARE * before[-1] and end - start < best[1] - best[0]:
            best = (start, end)

    tags = [(NAME.match(n[KEY].removeprefix("/")) or [""])[0] for n in nodes]
    most = max((n[TIMES] for n, tag in zip(nodes, tags, strict=True) if tag in CONTAINERS), default=0)
    for i, (n, tag) in enumerate(zip(nodes, tags, strict=True)):
        if n[KEY][0] == "/":
            key = n[KEY][1:]
            if any(nodes[start][KEY] == key for start in stack):
                while True:
                    start = stack.pop()
                    if tags[start] in CONTAINERS and 2 * nodes[start][TIMES] >= most:
                        closed(start, i)
                    if nodes[start][KEY] == key:
                        break
        elif n[KEY][0] not in "#+" and tag not in VOID:
            stack.append(i)
    for start in reversed(stack):
        if tags[start] in CONTAINERS and 2 * nodes[start][TIMES] >= most:
            closed(start, len(nodes))
    return best if before[-1] else (0, len(nodes))


def judged(blocks: list[list[list]]) -> list[list[list]]:
    """A host's wrapper, each slot's evidence replaced by whether it is template, and whether it is outside of the main part."""
    nodes = [n for b in blocks for n in b]
    start, end = main_part(nodes)
    title = 0

    def judge(n: list, outside: bool) -> None:
        if n[BODY] is not None:
            for x in n[BODY]:
                judge(x, outside)
        elif n[TEXTS]:
            n[TEXTS] = [(is_template(n), outside)]

    for i, n in enumerate(nodes):
        heading = (NAME.match(n[KEY].removeprefix("/")) or [""])[0] == "h1"
        title = max(0, title + heading * (-1 if n[KEY][0] == "/" else 1))
        judge(n, not start <= i < end and not title)
    return blocks


def decided(nodes: list[list], template: set[int], outside: set[int]) -> None:
    """Adds the numbers of a page's texts that align with slots of a judged wrapper that are template, or outside of the main part."""
    for n in nodes:
        if n[BODY] is not None:
            decided(n[BODY], template, outside)
        elif n[TEXTS] and isinstance(n[TEXTS][0], tuple):
            texts = [x for x in n[TEXTS] if not isinstance(x, tuple)]
            template.update(texts if n[TEXTS][0][0] else ())
            outside.update(texts if n[TEXTS][0][1] else ())


def blocks_of(nodes: list[list]) -> list[list[list]]:
    return [nodes[i : i + LONGEST] for i in range(0, len(nodes), LONGEST)]


def align_blocks(a: list[list[list]], b: list[list[list]]) -> list[list[list]]:
    return [align(x, y) if x and y else x or y for x, y in zip_longest(a, b, fillvalue=[])]


def bounded(blocks: list[list[list]]) -> list[list[list]]:
    """A wrapper; if it has over LONGEST optional nodes, only the half that came up most often, and what all pages have."""
    optional: list[list] = []

    def gather(nodes: list[list]) -> None:
        for n in nodes:
            if n[OPTIONAL]:
                optional.append(n)
            if n[BODY] is not None:
                gather(n[BODY])

    def kept(nodes: list[list]) -> list[list]:
        return [[*n[:BODY], None if n[BODY] is None else kept(n[BODY]), *n[TEXTS:]] for n in nodes if not n[OPTIONAL] or id(n) in best]

    for b in blocks:
        gather(b)
    if len(optional) <= LONGEST:
        return blocks
    best = {id(n) for n in sorted(optional, key=lambda n: -n[TIMES])[: LONGEST // 2]}
    return [kept(b) for b in blocks]


@lru_cache(256)
def wrapper_of(text: str) -> list[list[list]]:
    return judged(json.loads(text))


def main_text(html: str | None, wrapper: str | None) -> str:
    """The main text of a page by its host's wrapper."""
    found = events(html or "")
    own, any_main, linked = own_labels(found)
    template: set[int] = set()
    outside: set[int] = set()
    if wrapper:
        for known, mine in zip(wrapper_of(wrapper), blocks_of(fold(stream(found, own))), strict=False):
            decided(align(known, mine), template, outside)
    # what articles share, as headings that all of them have, is text of theirs: inside an article only the tags' and names' labels decide
    wanted, left_out = (2, set()) if any_main else (1, template | outside)
    doubtful = {i for i in range(len(found)) if own[i] == wanted + 2 and i not in template and i not in linked}
    blocks: list[list[str]] = [[]]
    varied = [False]  # whether a block has a text of its own
    for i, (kind, x, _) in enumerate(found):
        if kind == "#":
            if own[i] == wanted or i in doubtful:
                blocks[-1].append(x)
                varied[-1] |= i not in left_out and not x.isspace()
        elif x in BLOCKS:
            blocks.append([])
            varied.append(False)
        elif x == "br":
            blocks[-1].append(" ")
    return "\n".join(t for b, own_text in zip(blocks, varied, strict=True) if own_text and (t := " ".join(unescape("".join(b)).split())))


def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for each host among a task's pages."""
    made: dict[str, dict[tuple, list[list]]] = {}
    held = 0

    def flush() -> pd.DataFrame:
        rows = []
        for host, pages in made.items():
            whole: list[list[list]] = []
            for nodes in pages.values():
                whole = bounded(align_blocks(whole, blocks_of(nodes)))
            rows.append((host, json.dumps(whole)))
        made.clear()
        return pd.DataFrame(rows, columns=["host", "wrapper"])

    for pdf in batches:
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            found = events(html or "")
            own, _, linked = own_labels(found)
            if not (nodes := fold(stream(found, own))):
                continue
            nodes = witnessed(nodes, found, own, linked)
            shapes, kind = made.setdefault(host, {}), shape(nodes)
            if kind in shapes:
                shapes[kind] = align(shapes[kind], nodes)
            else:
                shapes[kind] = nodes
                held += size(nodes)
            if held > HELD:
                yield flush()
                held = 0
    yield flush()


def joined(wrappers: pd.Series) -> pd.Series:
    out = []
    for given in wrappers:
        whole, *rest = [json.loads(w) for w in given]
        for w in rest:
            whole = bounded(align_blocks(whole, w))
        out.append(json.dumps(whole))
    return pd.Series(out)


def host(url: Column) -> Column:
    return F.coalesce(split_url(url)[0], F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and wrapper (JSON) of every host, stored."""
    given = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))
    join = F.pandas_udf(joined, "string")
    merge = F.sort_array(F.collect_list("wrapper"))
    parts = stored(given.mapInPandas(induce, "host string, wrapper string").withColumn("part", F.monotonically_increasing_id()))

    def replaced(by: DataFrame) -> DataFrame:
        new = stored(by)
        discard(parts)
        return new

    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > FAN:
        salt = F.pmod(F.xxhash64("part"), F.lit(math.ceil(most / FAN))).alias("part")
        parts = replaced(parts.groupBy("host", salt).agg(merge.alias("w")).select("host", join("w").alias("wrapper"), "part"))
    return replaced(parts.groupBy("host").agg(merge.alias("w")).select("host", join("w").alias("wrapper")))


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the main text of each; an input column of that name is replaced."""
    rows = Rows(pages)
    known = wrappers(rows.df, rows.name(url), rows.name(html))
    hosted = rows.df.withColumns({"host": host(rows.col(url)), "spread": F.xxhash64(rows.col(html), rows.col(url))})
    if broadcastable(known):  # each Python worker has the wrappers once, instead of one with every page
        of_host = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in known.toLocalIterator()})
        discard(known)

        @F.pandas_udf("string")
        def by_host(htmls: pd.Series, hosts: pd.Series) -> pd.Series:
            return pd.Series([main_text(h, of_host.value.get(x)) for h, x in zip(htmls, hosts, strict=True)], dtype=object)

        found = hosted.withColumn("main", by_host(rows.col(html), F.col("host")))
    else:

        @F.pandas_udf("string")
        def by_wrapper(htmls: pd.Series, given: pd.Series) -> pd.Series:
            return pd.Series([main_text(h, w) for h, w in zip(htmls, given, strict=True)], dtype=object)

        found = join_small(hosted, known, ["host"], "spread").withColumn("main", by_wrapper(rows.col(html), F.col("wrapper")))
    return rows.restored(found, **{into: F.col("main")})


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
