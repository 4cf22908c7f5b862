"""Main text of HTML pages by wrappers inferred per host.

A page becomes a tree of elements and text.  Its wrapper is a union-free regular expression over that
tree: a sequence of items, each once, optional (``?``) or repeated (``+``, ``*``), with a slot for each
text.  Equal neighbours, and equal short runs of neighbours, fold into a repeated item, and more than
``LONGEST`` neighbours into a repeated group of optional items, one per label.  Two wrappers
of one host are aligned item by item: items that match are merged in depth, others become optional, and
what then repeats is folded again.  Equal wrappers are counted in their task, wrappers of one host are
merged in groups of bounded size until one is left, so neither a host with a third of all pages nor
one with very many layouts is a single task's work.

A wrapper's slots know how much text, and how much of it in links, they held over all pages of the host.
From this and the names of elements follows where the main text is: in ``article`` or ``main`` elements
that hold a fair share of the text, or else in the deepest element that holds most of it.  Each page is
then read through its host's wrapper; one without the wrapper's main element falls back to the same
choice on its own tree.  A wrapper's elements also know whether their text is the same on all pages that
have them.  Inside, hidden elements, tags and roles of menus, headers, footers, forms and scripts, and names that
hardly any text has (adverts, cookies, comments) are left out, if such a word and words of layout are a whole
class or id.  Other names with such words, and those that sections of an article have as well
(discussion, related, notice), are left out only if the host's pages agree: their text is the same on all
pages that have them, or most of it is in links.  Repeated blocks that each tell a person and a date are
readers' comments, and so is the element around them if they are most of it.  Containers of any name are left out if nearly all pages
of the host have them with the same text, unless that is most of the main text.
An article or main element is noise only if a whole class or id says so.  Then character references are decoded, white space in a block becomes one
space, and blocks are joined by line breaks.

Defined results: a null page is an empty one and has an empty text; text outside any element counts as
the page's; null URLs, and those without a host, share one wrapper; a ``br`` is white space; repeated rows
have equal results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices
from folioscope.llm.url_filter import split_url
from folioscope.session import stored

FAN_IN = 64
#: Elements nested deeper are beside each other, in page order, in their ancestor of this depth.
DEPTH = 60
#: A sequence of more items becomes a repeated group of its labels.
LONGEST = 400
#: The share of the text that an article or main element of a host holds at least.
FAIR_SHARE = 0.2
DEEPER_SHARE = 0.6

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table article section div main body aside nav header footer td th form blockquote".split())
NOISE_TAGS = frozenset("nav header footer aside form head button select option input menu dialog fieldset".split()) | RAW
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription social share sharing related recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments reply replies disqus discussion login signin signup search copyright toolbar pager pagination skip topbar responses feedback".split()
)
#: Of these, names that parts of an article have as well; they need the host's pages to agree.
SHARED_WORDS = frozenset(
    "alert banner copyright discussion footer login menu notice notices overlay promotion recommended recommendations related reply replies search share sharing sidebar signin signup skip "
    "social subscription widget widgets".split()
)
STRONG_WORDS = NOISE_WORDS - SHARED_WORDS
#: Words that say nothing of what an element holds.
LAYOUT_WORDS = frozenset("area bar block bottom box center col column container content inner item items large left link links list main outer panel right row section slot small thread top unit user wrap wrapper zone".split())
#: Names of parts that tell a person, and of those that tell a date.
WHO_WORDS = frozenset("author avatar byline commenter nickname poster username".split())
WHEN_WORDS = frozenset("ago date datetime posted published time timestamp".split())
WHO, WHEN = 1, 2
#: Marks a label that is noise by its name or hidden.
NOISY = "~"
#: What one page has says nothing about its host's; so many do.
MIN_PAGES = 5
NEARLY_ALL = 0.8
CONTAINERS = frozenset("div section ul ol dl table blockquote".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|\Z)", re.I)
_STYLE = re.compile(r"""(?:^|\s)style\s*=\s*["'][^"']*?(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)


class Element:
    """An element of a page (``parts``: elements and strings), or an item of a wrapper."""

    __slots__ = ("label", "parts", "noise", "tag", "signs")

    def __init__(self, tag: str, label: str, noise: bool, signs: int = 0):
        self.tag, self.label, self.noise, self.signs = tag, label, noise, signs
        self.parts: list = []


def _hidden(attributes: str) -> bool:
    if _STYLE.search(attributes):
        return True
    return "hidden" in attributes.lower() and bool(_HIDDEN.search(_QUOTED.sub("''", attributes)))


def _signs(tag: str, words: list[str]) -> int:
    return WHO * (not WHO_WORDS.isdisjoint(words)) | WHEN * (tag == "time" or not WHEN_WORDS.isdisjoint(words))


def _named(tag: str, attributes: str) -> tuple[str, bool, int]:
    """An element's label, whether its name says that it is not main text, and whether it tells who or when."""
    if not attributes:
        return tag, tag in NOISE_TAGS, _signs(tag, [])
    names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(attributes)}
    tokens = [[w.lower() for w in _WORD.findall(t)] for k in ("id", "class") for t in names.get(k, "").split()]
    words = [w for t in tokens for w in t]
    role = names.get("role", "").lower()
    if tag in ("article", "main") or role == "main":
        named = any(t and NOISE_WORDS.issuperset(t) for t in tokens)
    else:
        named = any(not STRONG_WORDS.isdisjoint(t) and all(w in NOISE_WORDS or w in LAYOUT_WORDS for w in t) for t in tokens)
    named = named or _hidden(attributes)
    label = ".".join([tag, *([NOISY] if named else []), *([role] if role else []), *words])
    return label, named or tag in NOISE_TAGS or role in NOISE_ROLES, _signs(tag, words)


def parse(page: str) -> Element:
    """A page as a tree; unclosed and stray tags are repaired."""
    root = Element("", "", False)
    stack = [root]
    at, raw = 0, None
    for m in _TOKEN.finditer(page):
        if raw is not None:
            if not (m[1] and m[2].lower() == raw):
                continue
            raw, at = None, m.end()
            continue
        if m.start() > at:
            _top(stack).parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in INLINE:
            _open_inline(stack, tag, m[3])
            continue
        # A block ends a paragraph and whatever was left open in it.
        closes = CLOSED_BY.get(tag, ())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ("p", "a") or stack[depth].tag in closes:
                del stack[depth:]
            elif stack[depth].tag in SCOPES:
                break
        if tag in VOID:
            _top(stack).parts.append(Element(tag, tag, False))
        elif tag in RAW:
            if not m[3].endswith("/"):
                raw = tag
        else:
            _open(stack, tag, m[3])
    if raw is None and at < len(page):
        rest = page[at:]
        # A tag that the end of the page cuts off is no text.
        cut = re.search(r"<[/!a-zA-Z][^<>]*\Z", rest)
        _top(stack).parts.append(rest[: cut.start()] if cut else rest)
    return root


def _top(stack: list[Element]) -> Element:
    """The innermost open element.  One below the deepest level goes on in a new element if others were
    opened beside it since, so that its parts stay in page order."""
    top = stack[-1]
    if len(stack) > DEPTH and top.tag not in INLINE:
        beside = stack[DEPTH - 1].parts
        if beside[-1] is not top:
            top = stack[-1] = Element(top.tag, top.label, top.noise, top.signs)
            beside.append(top)
    return top


def _open(stack: list[Element], tag: str, attributes: str) -> None:
    label, noise, signs = _named(tag, attributes)
    if len(stack) >= DEPTH:
        # Beside the elements it is in, and with them no main text.
        noise = noise or any(x.noise for x in stack[DEPTH:])
        label = f"{tag}.{NOISY}" if noise else label
    element = Element(tag, label, noise, signs)
    stack[min(len(stack), DEPTH) - 1].parts.append(element)
    stack.append(element)


def _open_inline(stack: list[Element], tag: str, attributes: str) -> None:
    """Of inline elements only links and hidden ones are elements of the tree; of others the names count."""
    if tag == "a" and stack[-1].tag == "a":
        stack.pop()
    top = _top(stack)
    if tag == "br":
        top.parts.append("\n")
        return
    if tag in VOID:
        return
    label, noise, signs = _named(tag, attributes)
    top.signs |= signs
    if top.noise and top.tag in INLINE:
        # What is in a hidden one has the same parts, so that each end meets its own start.
        element = Element(tag, label, True)
        element.parts = top.parts
        stack.append(element)
    elif tag == "a" or _hidden(attributes):
        element = Element(tag, label, noise, signs)
        top.parts.append(element)
        stack.append(element)


# --- wrappers: [label, mark, items, text, linked, same, pages, signs] with mark '', '?', '+' or '*'; same is
# a hash of the text, 0 if it varies, pages how many pages have the item, and signs whether it tells who or when ---


def wrapper_of(element: Element, linked: bool = False) -> list:
    """The wrapper of one page."""
    items = []
    linked = linked or element.tag == "a"
    for part in element.parts:
        if isinstance(part, str):
            if size := len(part.strip()):
                items.append(["#", "", [], size, size if linked else 0, zlib.crc32(part.strip().encode("utf-8", "replace")) or 1, 1, 0])
        elif part.tag == "a":
            items += [x for x in wrapper_of(part, True)[2] if x[0] == "#"]
        elif part.tag not in VOID:
            items.append(wrapper_of(part, linked))
    same = zlib.crc32(repr([x[5] for x in items]).encode()) or 1
    return [element.label, "", folded(items), 0, 0, same, 1, element.signs]


def _both(a: str, b: str) -> str:
    many, none = bool({a, b} & {"+", "*"}), bool({a, b} & {"?", "*"})
    return {(False, False): "", (False, True): "?", (True, False): "+", (True, True): "*"}[many, none]


def merged(a: list, b: list, repeated: bool = False) -> list:
    """One item for two with the same label."""
    mark = _both(a[1], b[1])
    if repeated:
        mark = "*" if {a[1], b[1]} <= {"?", "*"} else "+"
    pages = max(a[6], b[6]) if repeated else a[6] + b[6]
    return [a[0], mark, aligned(a[2], b[2]), a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else 0, pages, a[7] | b[7]]


def folded(items: list) -> list:
    """Neighbours with one label become a repeated item, and repeated runs of up to three a repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = merged(out[-1], item, True)
            continue
        out.append(item)
        for run in (2, 3):
            if len(out) >= 2 * run and [x[0] for x in out[-run:]] == [x[0] for x in out[-2 * run : -run]]:
                second, first = out[-run:], out[-2 * run : -run]
                del out[-2 * run :]
                out.append(["(" + " ".join(x[0] for x in first) + ")", "+", [merged(x, y) for x, y in zip(first, second, strict=True)], 0, 0, 0, first[0][6], 0])
                break
            if len(out) > run and out[-run - 1][0] == "(" + " ".join(x[0] for x in out[-run:]) + ")":
                group, more = out[-run - 1], out[-run:]
                del out[-run:]
                group[2] = [merged(x, y) for x, y in zip(group[2], more, strict=True)]
                break
    return bundled(out) if len(out) > LONGEST else out


def _optional(item: list) -> list:
    return [item[0], _both(item[1], "?"), *item[2:]]


def _members(items: list) -> dict[str, list]:
    """The items by label, those of groups too."""
    found: dict[str, list] = {}
    for item in items:
        for x in _members(item[2]).values() if item[0].startswith("(") else [item]:
            found[x[0]] = merged(found[x[0]], x, True) if x[0] in found else x
    return found


def bundled(*sequences: list) -> list:
    """Sequences, of other pages each, as one repeated group of optional items, one per label."""
    members: dict[str, list] = {}
    for items in sequences:
        for label, x in _members(items).items():
            members[label] = merged(members[label], x) if label in members else x
    inner = [_optional(members[x]) for x in sorted(members)]
    return [["(" + " ".join(x[0] for x in inner) + ")", "+", inner, 0, 0, 0, max(x[6] for x in inner), 0]]


def aligned(a: list, b: list) -> list:
    """Two sequences as one: what matches in order is merged, what does not becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    if max(len(a), len(b)) > LONGEST or any(len(x[2]) > 3 for x in (*a, *b) if x[0].startswith("(")):
        return bundled(a, b)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return folded(out)


def expression(item: list) -> str:
    """A wrapper in the notation of regular expressions, slots as #text."""
    if item[0] == "#":
        return "#text" + item[1]
    inner = " ".join(expression(x) for x in item[2])
    if item[0].startswith("("):
        return f"( {inner} ){item[1]}"
    body = f"<{item[0]}> {inner} </{item[0].split('.')[0]}>" if item[0] else inner
    return f"( {body} ){item[1]}" if item[1] else body


def _shape(item: list) -> list:
    return [item[0], item[1], [_shape(x) for x in item[2]]]


# --- where the main text is ---


def _is_noise(label: str) -> bool:
    tag, *words = label.split(".")
    return NOISY in words or tag in NOISE_TAGS or bool(words and words[0] in NOISE_ROLES)


def _is_main(label: str) -> bool:
    tag, *words = label.split(".")
    return NOISY not in words and (tag in ("article", "main") or (bool(words) and words[0] == "main"))


def main_paths(wrapper: list) -> list[str]:
    """The paths of labels of the elements that hold the main text."""
    mains: dict[str, dict[str, float]] = {"article": {}, "main": {}}

    def mass(item: list, path: str) -> float:
        """Unlinked text outside noise; notes article and main elements on the way."""
        if item[0] == "#":
            return max(0, item[3] - item[4])
        grouped = item[0].startswith("(")
        if not grouped and item[0]:
            path = f"{path}/{item[0]}"
        main = not grouped and _is_main(item[0])
        # The name of an element around a main one may be anything but a page's own frame.
        if not grouped and not main and _is_noise(item[0]) and item[0].split(".")[0] in NOISE_TAGS:
            return 0.0
        own = sum(mass(x, path) for x in item[2])
        if main:
            kind = "article" if item[0].startswith("article") else "main"
            mains[kind][path] = mains[kind].get(path, 0.0) + own
        return 0.0 if not grouped and not main and item[0] and _is_noise(item[0]) else own

    total = mass(wrapper, "")
    for kind in ("article", "main"):
        if mains[kind] and sum(mains[kind].values()) >= FAIR_SHARE * total:
            return sorted(p for p, v in mains[kind].items() if v > 0) or sorted(mains[kind])
    # No such element: the deepest one with most of the text.
    path, item = "", wrapper
    whole = _plain_mass(wrapper)
    while whole:
        blocks = [x for y in item[2] for x in (y[2] if y[0].startswith("(") else [y])]
        inner = [x for x in blocks if x[0].split(".")[0] in SCOPES | {"html"} and not _is_noise(x[0])]
        best = max(inner, key=_plain_mass, default=None)
        if best is None or _plain_mass(best) < DEEPER_SHARE * whole:
            break
        path, item = f"{path}/{best[0]}", best
    return [path]


def left_out(wrapper: list, mains: list[str]) -> list[str]:
    """The paths inside the main elements that the host's pages show to be no main text."""
    # By path: text, linked text, whether it is the same wherever it is, pages, words of the label.
    seen: dict[str, list] = {}
    replies: dict[str, int] = {}
    same: dict[str, set] = {}
    # The text of the main elements, and whether it varies: that of copies tells nothing apart.
    whole = [0, False]

    def visit(item: list, path: str, inside: bool, repeated: bool = False) -> tuple[int, int, int]:
        if item[0] == "#":
            return item[3], item[4], 0
        grouped = item[0].startswith("(")
        repeated = item[1] in ("+", "*") or (repeated and not item[0] == "")
        if not grouped and item[0]:
            path = f"{path}/{item[0]}"
        below = [visit(x, path, inside or path in mains, grouped and repeated) for x in item[2]]
        text, linked = sum(x[0] for x in below), sum(x[1] for x in below)
        signs = item[7]
        for x in below:
            signs |= x[2]
        if inside and not grouped and path not in mains:
            have = seen.setdefault(path, [0, 0, True, 0, item[0].split(".")])
            have[0], have[1], have[2], have[3] = have[0] + text, have[1] + linked, have[2] and bool(item[5]), have[3] + item[6]
            # Two places with one path that differ are not the same text.
            same.setdefault(path, set()).add(item[5])
            # A block of its own parts, as a reader's comment is, not a line of a list.
            if repeated and signs == WHO | WHEN and any(x[0] != "#" for x in item[2]) and not _is_main(item[0]):
                replies[path] = replies.get(path, 0) + text
        elif path in mains and not grouped and (item is wrapper or not inside):
            whole[0] += text
            whole[1] |= not item[5]
        return text, linked, signs

    visit(wrapper, "", "" in mains)
    enough = wrapper[6] >= MIN_PAGES and whole[1]
    named, plain = [], []
    for path, (text, linked, constant, pages, (tag, *words)) in seen.items():
        constant = enough and constant and len(same[path]) == 1 and pages > 1
        if not text:
            continue
        if not NOISE_WORDS.isdisjoint(words) and (constant or 2 * linked >= text):
            named.append(path)
        elif constant and tag in CONTAINERS and pages >= NEARLY_ALL * wrapper[6]:
            plain.append(path)
    for path, text in replies.items():
        around = path.rpartition("/")[0]
        if around in seen and 2 * text >= seen[around][0]:
            path = around
        # A main element of nothing else is a page of posts.
        if 2 * seen[path][0] < whole[0]:
            named.append(path)
    outer = [p for p in plain if not any(p.startswith(q + "/") for q in plain)]
    if 2 * sum(seen[p][0] for p in outer) >= whole[0]:
        plain = []
    return sorted({*named, *plain})


def _plain_mass(item: list) -> float:
    if item[0] == "#":
        return max(0, item[3] - item[4])
    if not item[0].startswith("(") and item[0] and _is_noise(item[0]):
        return 0.0
    return sum(_plain_mass(x) for x in item[2])


def main_text(root: Element, paths: list[str], out: list[str] | tuple = ()) -> str:
    """The text below the elements at ``paths`` without those at ``out``, or below those that the page itself suggests."""
    wanted = frozenset(paths)
    blocks, found = _blocks(root, wanted, frozenset(out))
    if not found:
        blocks, _ = _blocks(root, frozenset(main_paths(wrapper_of(root))))
    return "\n".join(blocks)


def _blocks(root: Element, wanted: frozenset[str], out: frozenset[str] = frozenset()) -> tuple[list[str], bool]:
    blocks: list[str] = []
    run: list[str] = []
    found = False

    def close() -> None:
        if run:
            if text := " ".join(html_module.unescape("".join(run)).split()):
                blocks.append(text)
            run.clear()

    def visit(element: Element, path: str, inside: bool) -> None:
        nonlocal found
        for part in element.parts:
            if isinstance(part, str):
                if inside:
                    run.append(part)
                continue
            if part.tag in INLINE:
                visit(part, path, inside) if not (inside and part.noise) else None
                continue
            close()
            below = f"{path}/{part.label}"
            here = inside or below in wanted
            found = found or here
            if not (here and (part.noise or below in out) and below not in wanted):
                visit(part, below, here)
            close()

    start = "" in wanted
    found = start
    visit(root, "", start)
    close()
    return blocks, found


# --- Spark ---


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct wrappers of a task's pages, by host, with the text they held."""
    known: dict[tuple[str, str], list] = {}
    for batch in slices(batches, 1):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            wrapper = wrapper_of(parse(page or ""))
            key = (host, json.dumps(_shape(wrapper)))
            have = known.get(key)
            known[key] = wrapper if have is None else merged(have, wrapper)
        if len(known) > 20_000:
            yield _wrapper_rows(known)
            known = {}
    yield _wrapper_rows(known)


def _wrapper_rows(known: dict[tuple[str, str], list]) -> pa.RecordBatch:
    hosts = pa.array([h for h, _ in known], pa.string())
    return pa.RecordBatch.from_arrays([hosts, pa.array([json.dumps(w) for w in known.values()], pa.string())], names=["host", "wrapper"])


def _merged_group(table: pa.Table) -> pa.Table:
    wrappers = sorted(table.column("wrapper").to_pylist())
    whole = json.loads(wrappers[0])
    for other in wrappers[1:]:
        whole = merged(whole, json.loads(other))
    return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([json.dumps(whole)])})


def infer_wrappers(pages: DataFrame, html_col: str = "html", url_col: str = "url", fan_in: int = FAN_IN) -> DataFrame:
    """``(host, wrapper)``: one wrapper per host over all its pages, as JSON."""
    host, _ = split_url(F.col(url_col).cast("string"))
    rows = pages.select(host.alias("host"), F.col(html_col).cast("string").alias("html"))
    wrappers = stored(rows.mapInArrow(_inferred, "host string, wrapper string"), "wrappers")
    while True:
        counts = wrappers.groupBy("host").count()
        most = counts.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return wrappers
        # Parts of at most about fan_in wrappers, dealt by their hash.
        parts = counts.select("host", F.ceil(F.col("count") / fan_in).alias("parts"))
        dealt = wrappers.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
        wrappers = stored(dealt.groupBy("host", "part").applyInArrow(_merged_group, "host string, wrapper string"), "wrappers")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for wrapper in map(json.loads, batch.column(1).to_pylist()):
            paths = main_paths(wrapper)
            found.append(json.dumps([paths, left_out(wrapper, paths)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["wrapper_host", "places"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last two columns, page and places, by the text."""
    for batch in slices(batches, -2):
        pages, places = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        texts = [main_text(parse(page or ""), *json.loads(place or "[[]]")) for page, place in zip(pages, places, strict=True)]
        columns = [*batch.columns[:-2], pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "main_text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``row_id, row_url, main_text`` of every page."""
    places = stored(infer_wrappers(pages, html_col, url_col).mapInArrow(_places, "wrapper_host string, places string"), "places")
    host, _ = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).cast("string").alias("row_url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    key = rows.schema["row_id"].dataType.simpleString()
    joined = rows.join(places, F.col("host") == F.col("wrapper_host"), "left").select("row_id", "row_url", "html", "places")
    return joined.mapInArrow(_extracted, f"row_id {key}, row_url string, main_text string")
