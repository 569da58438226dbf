"""Main text of web pages by wrappers inferred per host as union-free regular expressions.

A page is a stream of block tags and text slots. Its structure is folded: equal siblings and repeated
groups of siblings become one repeated item. Pages of a host are told apart by folded structure only,
so a host with a third of all pages leaves a few structures behind, counted by Spark. A host's
structures are then aligned one after the other: what is missing on one side becomes optional, what
repeats becomes a repeated group, differing text a slot. The result is a wrapper, a regular
expression without unions, and a set of slots. Pages with an article, with a main element, with a box
named as content, and others are different kinds of a host, each with a wrapper of its own. Which
slots are main text is decided per host and kind from the wrapper and from counts of all its pages: slots under navigation, headers, footers, asides,
forms and boxes named as adverts, notices, comments and the like are not; article or main elements
win where there are any, else boxes named as content, else all; in the last two, slots whose text
never changes over five different pages or is mostly links are left out. A class name counts whole:
`post-comments` names a box of comments, `no-sidebar` and `header-fixed` a state of something else.

A page's text is that of its slots that are main slots of its host and kind; where that is nothing,
the same rule is applied to the page alone. Character references
are decoded, white space runs become one space, blocks are joined by a line feed. Inline markup and
line breaks are white space or nothing. Null or empty html gives an empty text; a null url, or one
without a host, belongs to the host ''. Repeated rows are extracted each. Whole pages are read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.llm.common import stored

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "select", "button")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw elements that hold text up to their end tag, or to the end of the page; of others an unclosed tag counts as no tag.
TO_THE_END = frozenset("script style textarea noscript iframe".split())
#: Elements that an opening tag of the key closes, up to the nearest of the barriers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head", "title"}, {"html"}),
}
ENDS_P = BLOCKS - {"html", "head", "title", "body", "option", "optgroup"}
OFF_TAGS = frozenset("head title nav header footer aside form dialog menu search fieldset".split())
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer foot sidebar aside widget related recommended comment comments disqus "
    "reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login "
    "social share sharing toolbar pagination pager copyright legal skip search form".split()
)
#: A name with one of these says how something else stands, as in no-sidebar or header-fixed.
STATE_WORDS = frozenset("no not has have with without is fixed sticky open opened closed hidden hide show shown enabled disabled off on".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
BESIDE_MAIN = frozenset("page blog news site single".split())
BOXES = frozenset("div section td center article main".split())
#: Words that decide about a slot stay in a label whatever their place; of others the first six.
TELLING = OFF_WORDS | MAIN_WORDS | {"teaser"}
SALTS = 16
MOST_LABELS = 64
MOST_CHILDREN = 200  # longer lists of siblings are told by label only
MOST_DEPTH = 64  # of deeper nesting a path keeps the outer and the inner half
DIFFERENT = 5  # pages of different text from which an unchanging slot is no main text; no more are told apart
BROADCAST_CHARS = 16 << 20
FLUSH = 50_000
#: A tag: quotes count only behind an equals sign, and only if they are closed. Nothing here is scanned twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_NAME = re.compile(r"[^a-z_-]+")


@lru_cache(100_000)
def _parts(name: str) -> frozenset[str]:
    return frozenset(re.split("[-_]+", name))


def _label(tag: str, rest: str) -> str:
    """The tag with the names of its class, id and role, without digits."""
    if "=" not in rest:
        return tag
    names: dict[str, None] = {}
    for found in _NAMES.findall(rest):
        for name in " ".join(found).split():
            name = _NO_NAME.sub("", _CAMEL.sub("-", name).lower()).strip("-_")
            if name:
                names[name] = None
    known = list(names)
    return ".".join([tag, *known[:6], *(n for n in known[6:] if TELLING & _parts(n))])


def tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before it, whether it closes, tag, attributes, place) of every tag; the text after the last has no tag.

    Comments, declarations and raw elements are passed over. A tag that the page's end cuts off is no text.
    """
    at = done = 0
    ended: set[str] = set()  # raw elements that have no end tag any more
    while True:
        begin = page.find("<", at)
        if begin < 0:
            yield page[done:], False, "", "", len(page)
            return
        follows = page[begin + 1 : begin + 2]
        if follows.isascii() and follows.isalpha() or follows == "/" and page[begin + 2 : begin + 3].isalpha():
            found = _TAG.match(page, begin)
            if found is None:
                yield page[done:begin], False, "", "", len(page)
                return
            at, tag, rest = found.end(), found[2].lower(), found[3]
            if tag in _RAW_END and not found[1] and tag not in ended and not (tag in ("svg", "math") and rest.endswith("/")):
                end = _RAW_END[tag].search(page, at)
                if end is None:
                    ended.add(tag)
                if end is not None or tag in TO_THE_END:
                    at = end.end() if end is not None else len(page)
                    tag = "#raw"
            yield page[done:begin], bool(found[1]), tag, rest, begin
        elif follows and follows in "!?/":
            end = page.find("-->", begin + 4) if page.startswith("<!--", begin) else page.find(">", begin)
            at = len(page) if end < 0 else end + (3 if page.startswith("<!--", begin) else 1)
            yield page[done:begin], False, "#none", "", begin
        else:  # a less-than sign
            at = begin + 1
            continue
        done = at


def slots(page: str) -> Iterator[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """(path of block labels, text, characters inside links, the path's elements) of every text block in page order."""
    stack: list[tuple[str, str, int]] = []  # (tag, label, number of the element)
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    text: list[str] = []
    linked, in_link = 0, 0

    def cut(place: int) -> None:
        for tag, _, _ in stack[place:]:
            where[tag].pop()
        del stack[place:]

    def close(tags: set[str], barriers: set[str]) -> bool:
        """Close the innermost of these elements, unless a barrier is further in."""
        place = max((where[t][-1] for t in tags if where.get(t)), default=-1)
        if place < 0 or any(where[t][-1] > place for t in barriers if where.get(t)):
            return False
        cut(place)
        return True

    def block() -> Iterator[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
        body = " ".join(html.unescape("".join(text)).split())
        if body:
            half = MOST_DEPTH // 2
            path = stack if len(stack) <= MOST_DEPTH else stack[:half] + stack[-half:]
            yield tuple(x[1] for x in path), body, linked, tuple(x[2] for x in path)

    for piece, closes, tag, rest, place in tokens(page):
        if piece:
            text.append(piece)
            linked += len(piece) * (in_link > 0)
        if tag not in BLOCKS:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = 0 if closes else 1
            continue
        yield from block()
        text, linked, in_link = [], 0, 0
        if closes:
            close({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div", "section") else set())
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if tag in CLOSES:
            closed, barriers = CLOSES[tag]
            while close(closed, barriers):
                pass
        if tag not in VOID:
            where[tag].append(len(stack))
            stack.append((tag, _label(tag, rest), place))
    yield from block()


# A structure is [label, optional, repeated, children]; a slot's label is "#", a group's is "()".


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [x[0] for x in a[3]] == [x[0] for x in b[3]])


def _align(a: list, b: list) -> list:
    """One item that stands for both; their labels are equal."""
    return [a[0], a[1] or b[1], a[2] or b[2], _fold(_align_lists(a[3], b[3]))]


def _align_lists(a: list, b: list) -> list:
    """Longest common sequence of labels; what only one side has becomes optional."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if _same(a[i], b[j]):
            out.append(_align(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return out + [[x[0], True, *x[2:]] for x in a[i:] + b[j:]]


def _fold(items: list) -> list:
    """Equal neighbours, and repeated runs of two or three siblings, as one repeated item."""
    for size in (1, 2, 3):
        out: list = []
        for item in items:
            out.append(item)
            head, tail = out[-2 * size : -size], out[-size:]
            if len(head) == size and all(map(_same, head, tail)):
                merged = [_align(x, y) for x, y in zip(head, tail, strict=True)]
                if size == 1:
                    out[-2:] = [[merged[0][0], merged[0][1], True, merged[0][3]]]
                else:
                    out[-2 * size :] = [["()", False, True, merged]]
            elif size > 1 and len(out) > size and out[-size - 1][0] == "()" and len(out[-size - 1][3]) == size:
                if all(map(_same, out[-size - 1][3], tail)):
                    group = [_align(x, y) for x, y in zip(out[-size - 1][3], tail, strict=True)]
                    out[-size - 1 :] = [["()", out[-size - 1][1], True, group]]
        items = out
    return items


def structure(paths: list[tuple[tuple[str, ...], tuple[int, ...]]]) -> list:
    """The folded structure of one page from the paths and elements of its slots in order."""
    root: list = ["", False, False, []]
    open_: list[list] = [root]
    last: tuple[int, ...] = ()
    for path, elements in paths:
        keep = 0
        while keep < min(len(path), len(last)) and elements[keep] == last[keep]:
            keep += 1
        del open_[keep + 1 :]
        for label in path[keep:]:
            item: list = [label, False, False, []]
            open_[-1][3].append(item)
            open_.append(item)
        open_[-1][3].append(["#", False, False, []])
        last = elements

    def fold(item: list) -> list:
        return [item[0], item[1], item[2], _short(_fold([fold(x) for x in item[3]]))]

    return fold(root)


def _short(items: list) -> list:
    """Siblings too many to align in order: one repeated item of each label."""
    if len(items) <= MOST_CHILDREN:
        return items
    by_label: dict[str, list] = {}
    for item in items:
        inner = item[3] if item[0] == "()" else [item]
        for x in inner:
            old = by_label.get(x[0])
            by_label[x[0]] = [x[0], True, True, _short(_align_lists(old[3], x[3])) if old is not None else x[3]]
    return list(by_label.values())


def align(a: list, b: list) -> list:
    """The wrapper of two structures or wrappers; a node with too many kinds of children keeps their tags only."""
    out = _align(a, b)

    def narrow(item: list) -> list:
        children = item[3]
        if len({x[0] for x in children}) > MOST_LABELS:
            children = _fold([[x[0].split(".")[0] + "." if x[0] not in ("#", "()") else x[0], *x[1:]] for x in children])
        children = _short(children)
        return [item[0], item[1], item[2], [narrow(x) for x in children]]

    return narrow(out)


def as_expression(item: list) -> str:
    """The wrapper as text: label(children), ? for optional, + for repeated, # for a slot."""
    inner = " ".join(as_expression(x) for x in item[3])
    name = "" if item[0] == "()" else item[0]
    return name + (f"({inner})" if item[3] else "") + ("+" if item[2] else "") + ("?" if item[1] else "")


def wrapper_slots(item: list, path: tuple[str, ...] = ()) -> set[tuple[str, ...]]:
    """Paths of the slots that a wrapper holds."""
    own = path if item[0] in ("", "()", "#") else (*path, item[0])
    found = {path} if item[0] == "#" else set()
    return found.union(*(wrapper_slots(x, own) for x in item[3])) if item[3] else found


def _off(path: tuple[str, ...]) -> bool:
    """Whether a slot lies in something other than the main text."""
    inside = False
    for label in path:
        tag, *names = label.split(".")
        inside = inside or tag in ("article", "main")
        if tag in OFF_TAGS and not (tag == "header" and inside):
            return True
        if tag not in ("html", "body", "main", "article") and any(map(_off_name, names)):
            return True
        if tag == "article" and any({"comment", "comments", "related", "promo", "ad", "teaser"} & _parts(n) for n in names):
            return True
    return False


@lru_cache(100_000)
def _off_name(name: str) -> bool:
    return bool(OFF_WORDS & _parts(name)) and not STATE_WORDS & _parts(name)


@lru_cache(100_000)
def _main_name(name: str) -> bool:
    return bool(MAIN_WORDS & _parts(name)) and _parts(name) <= MAIN_WORDS | BESIDE_MAIN


def _named(path: tuple[str, ...]) -> bool:
    """Whether a box around the slot is named as content, by a whole name."""
    return any(tag in BOXES and any(map(_main_name, names)) for tag, *names in (label.split(".") for label in path))


def kind_of(paths: set[tuple[str, ...]]) -> str:
    """What the main text of a page with these slots is in: an article, a main element, a named box, or none of them."""
    left = [p for p in paths if not _off(p)]
    for tag in ("article", "main"):
        if any(label.split(".")[0] == tag for p in left for label in p):
            return tag
    return "named" if any(map(_named, left)) else "plain"


def main_slots(stats: dict[tuple[str, ...], dict]) -> set[tuple[str, ...]]:
    """The slots of the main text among those of a wrapper, by counts over all pages of the host."""
    left = {p: s for p, s in stats.items() if not _off(p)}

    for tag in ("article", "main"):
        inner = {p for p in left if any(label.split(".")[0] == tag for label in p)}
        if inner:
            return inner
    plain = {
        p: s
        for p, s in left.items()
        if 2 * s["linked"] <= s["chars"] and not (len(s["marks"]) >= DIFFERENT and s["low"] == s["high"])
    }
    named = {p for p in plain if _named(p)}
    if named:
        plain = {p: plain[p] for p in named}
    return set(plain)


_PAGE_SCHEMA = "host string, kind string, key string, pages long, chars long, linked long, low long, high long, marks array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Structures and slots of the pages (host, html) of a task, counted."""
    names = ["host", "kind", "key", "pages", "chars", "linked", "low", "high", "marks"]
    types = [pa.string()] * 3 + [pa.int64()] * 5 + [pa.list_(pa.int64())]
    counted: dict[tuple[str, str, str], list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in counted.items()]
        counted.clear()
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def add(key: tuple[str, str, str], chars: int, linked: int, mark: int, page: int) -> None:
        old = counted.get(key)
        if old is None:
            counted[key] = [1, chars, linked, mark, mark, [page]]
        else:
            old[0] += 1
            old[1] += chars
            old[2] += linked
            old[3], old[4] = min(old[3], mark), max(old[4], mark)
            if page not in old[5]:
                old[5] = sorted([*old[5], page])[:DIFFERENT]

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = page.as_py()
            if not body:
                continue
            paths, by_path, whole = [], {}, []
            for path, text, linked, elements in slots(body):
                paths.append((path, elements))
                whole.append(text)
                got = by_path.setdefault(path, [0, 0, []])
                got[0] += len(text)
                got[1] += linked
                got[2].append(text)
            host, page_mark = f"{kind_of(set(by_path))} {host}", _mark("\n".join(whole))
            add((host, "page", json.dumps(structure(paths))), 0, 0, 0, page_mark)
            for path, (chars, linked, texts) in by_path.items():
                add((host, "slot", json.dumps(path)), chars, linked, _mark("\n".join(texts)), page_mark)
            if len(counted) > FLUSH:
                yield flush()
    yield flush()


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def _merge_structures(rows: pd.DataFrame) -> pd.DataFrame:
    merged = None
    for key in rows.sort_values(["pages", "key"], ascending=[False, True])["key"]:
        merged = json.loads(key) if merged is None else align(merged, json.loads(key))
    return pd.DataFrame({"host": rows["host"].iloc[:1], "key": [json.dumps(merged)], "pages": [int(rows["pages"].sum())]})


def _decide(key: tuple, wrappers: pd.DataFrame, slot_rows: pd.DataFrame) -> pd.DataFrame:
    if wrappers.empty:
        return pd.DataFrame({"host": [], "wrapper": [], "main": []})
    wrapper = json.loads(_merge_structures(wrappers)["key"].iloc[0])
    there = wrapper_slots(wrapper)
    # A wrapper whose node had too many kinds of children holds their tags only.
    tags = {tuple(label.split(".")[0] for label in path) for path in there}
    stats = {}
    for row in slot_rows.to_dict("records"):
        path = tuple(json.loads(row["key"]))
        if path in there or tuple(label.split(".")[0] for label in path) in tags:
            stats[path] = row
    kind, host = key[0].split(" ", 1)
    main = sorted(json.dumps([kind, *p]) for p in main_slots(stats))
    return pd.DataFrame({"host": [host], "wrapper": [f"{kind}: {as_expression(wrapper)}"], "main": ["\n".join(main)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, main) from pages(host, html): a host's expressions and main slots, one per line after their kind."""
    described = pages.select("host", "html").mapInArrow(_describe, _PAGE_SCHEMA)
    counted = stored(
        described.groupBy("host", "kind", "key").agg(
            *(F.sum(c).alias(c) for c in ("pages", "chars", "linked")), F.min("low").alias("low"), F.max("high").alias("high"),
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))), 1, DIFFERENT).alias("marks"),
        )
    )
    structures = counted.filter("kind = 'page'").select("host", "key", "pages")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    partial = structures.withColumn("salt", salt).groupBy("host", "salt")
    partial = partial.applyInPandas(_merge_structures, "host string, key string, pages long")
    slot_rows = counted.filter("kind = 'slot'").select("host", "key", "pages", "chars", "linked", "low", "high", "marks")
    decided = (
        partial.groupBy("host")
        .cogroup(slot_rows.groupBy("host"))
        .applyInPandas(_decide, "host string, wrapper string, main string")
    )
    # At most four kinds of a host.
    lines = (F.concat_ws("\n", F.array_sort(F.collect_list(c))).alias(c) for c in ("wrapper", "main"))
    return decided.groupBy("host").agg(*lines)


def _text(page: str, wanted: frozenset) -> str:
    """The text of a page's main slots, or if it has none, of those that it has by itself."""
    found = list(slots(page))
    kind = kind_of({path for path, *_ in found})
    text = "\n".join(text for path, text, _, _ in found if (kind, *path) in wanted)
    if text or not found:
        return text
    stats: dict[tuple[str, ...], dict] = {}
    for path, body, linked, _ in found:
        own = stats.setdefault(path, {"chars": 0, "linked": 0, "low": 0, "high": 0, "marks": []})
        own["chars"] += len(body)
        own["linked"] += linked
    main = main_slots(stats)
    return "\n".join(text for path, text, _, _ in found if path in main)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset] = {}
    for batch in batches:
        texts = []
        for page, main in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            if main not in known:
                if len(known) > 10_000:
                    known.clear()
                known[main] = frozenset(tuple(json.loads(x)) for x in (main or "").split("\n") if x)
            wanted = known[main]
            texts.append(_text(page.as_py() or "", wanted))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, host: Column, wrappers: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text) for every row of pages(page_id, url, html); `host` groups pages of one template."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.coalesce(host, F.lit("")).alias("host"),
    )
    wrappers = stored((infer_wrappers(rows) if wrappers is None else wrappers).select("host", "main"))
    chars = wrappers.agg(F.sum(F.length("main") + F.length("host"))).first()[0] or 0
    side = F.broadcast(wrappers) if chars <= BROADCAST_CHARS else wrappers
    joined = rows.join(side, "host", "left").select("page_id", "url", "html", "main")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")
