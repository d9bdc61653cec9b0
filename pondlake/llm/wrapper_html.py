"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements, in which siblings of one label
(tag, classes, id) are one node: repeated records are one slot. Per host, the
most common tree is the reference; every other tree of the host is aligned with
it by simple tree matching (order-preserving maximum match of equal labels).
Slots that align are one slot of the host, as are slots of one path that the
reference lacks. A slot whose text is the same on all its pages is template, while
varying slots are content. In trees without an article element a block of a varying
slot is template too if its text stands on most pages of the slot: the constant
paragraph among varying ones, which shares their label. Menus, footers and
adverts also vary, so a slot is left out as well when an element on its path
says so by tag, class, id or role, or when nearly all its text is links. What only
a name or a form says does not hold for an article or main element below it, and
a page that would come out empty falls back on its slots of that kind.

The parsed blocks are written once to the shared folder. What decides about
slots is an aggregate of them (least and greatest text hash a slot, with
map-side combine, so a host holding a third of all pages is one row a task); trees
are aligned one distinct tree at a time; the labels come back by a join on
(host, tree) that broadcasts only a counted small side.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, ship, sized_join

#: A constant slot is template from so many pages of a host on; fewer prove nothing.
LEAST_PAGES = 5
#: A block of a varying slot is template beyond this share of the slot's distinct pages.
BLOCK_SHARE = 0.5
#: A slot with this share of its text in links is a menu.
LINK_SHARE = 0.8
#: Elements nested deeper than this share their ancestor's slot.
DEEPEST = 64

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select canvas audio video".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    " caption head button search".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button"} | {"hr"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
P_SCOPE = ("td", "th", "table", "caption", "button")
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}}
LEFT_OUT_TAGS = frozenset("head nav footer aside form menu dialog button search".split())
#: Words of a class, id or role that name what is not the article.
LEFT_OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside notice notices cookie cookies consent gdpr banner"
    " ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored form comment comments respond"
    " reply replies disqus newsletter subscribe subscription signup login share sharing social related recommended breadcrumb"
    " breadcrumbs pagination pager popup modal overlay widget search copyright complementary contentinfo alert toolbar"
    " tracking skip hidden".split())
#: A name that ends so (widget-text, banner-body) names a text; in an article it says nothing.
TEXT_WORDS = frozenset("text body content copy title heading paragraph caption inner main".split())
#: The same, for names written in one word (commentlist, cookiebar, sidebarleft).
LEFT_OUT_STEMS = ("comment", "cookie", "advert", "sidebar", "breadcrumb", "newsletter", "sponsor", "footer", "navbar")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PARSED = "page_id long, url string, host string, tree string, blocks array<struct<slot:int,text:string,links:int>>"
#: Elements that hold the text itself: a name on them, as on a heading's anchor, says nothing.
PLAIN = frozenset("html body article main h1 h2 h3 h4 h5 h6 hgroup p pre blockquote figcaption caption dt dd td th".split())
#: A class that begins so tells of the page, not of the element (has-sidebar, no-comments).
MODIFIERS = frozenset("has have with without no not is hide show".split())
#: Words that count only as a whole name (not hidden-layers).
WHOLE_NAMES = frozenset("hidden skip alert".split())


def _named(tag: str, found: dict[str, str]) -> str:
    """``?`` if a class, id or role names a container that is not the article's, ``~?`` if
    only names that end in a word for text do, else nothing."""
    if tag in PLAIN:
        return ""
    # ids of sections and of inline elements are generated from headings
    kinds = ("class", "id", "role") if tag in BLOCKS and tag != "section" else ("class", "role")
    mark = ""
    for name in (x for k in kinds for x in unescape(found.get(k, "")).split()):
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in MODIFIERS and any(
                (w in LEFT_OUT_WORDS and (w not in WHOLE_NAMES or len(words) == 1))
                or (w.startswith(LEFT_OUT_STEMS) and w != "commentary") for w in words):
            if words[-1] not in TEXT_WORDS:
                return "?"
            mark = "~?"
    return mark


@lru_cache(4096)
def _label(tag: str, attrs: str) -> str:
    """Tag with its classes and id, less numbers that count records; ``!`` where it is not
    the article's by what it is, ``?`` where it is so by name only or is a form, ``~?``
    where the name ends in a word for text."""
    if not attrs:
        return tag + ("?" if tag == "form" else "!" if tag in LEFT_OUT_TAGS else "")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    words = sorted({w.lower() for k in ("class", "id", "role") for w in _WORD.findall(unescape(found.get(k, "")))})
    out = ((tag in LEFT_OUT_TAGS and tag != "form") or "hidden" in found or found.get("aria-hidden") == "true"
           or (tag == "article" and bool({"comment", "comments", "ad", "related"} & set(words))))
    names = [re.sub(r"\d{3,}", "", x) for x in sorted(unescape(found.get("class", "")).split())]
    names += [re.sub(r"\d+", "", x) for x in unescape(found.get("id", "")).split()]
    return re.sub(r"[/!?~\n]", "", ".".join([tag, *names])) + ("!" if out else "?" if tag == "form" else _named(tag, found))


def parse(html: str) -> tuple[list[str], list[tuple[int, str, int]]]:
    """The tree of a page, as the paths of its slots in order of appearance, and its
    text blocks as (slot, text, characters in links).

    Character references are decoded and white space inside a block is one space.
    End tags left out are implied as the HTML standard does for paragraphs, list
    items and table cells; raw-text elements, comments and markup have no text. A
    quote left open in a tag ends with the tag, a tag left open with the page.
    """
    slots: dict[str, int] = {}
    blocks: list[tuple[int, str, int]] = []
    stack: list[tuple[str, str]] = [("", "")]  # open block elements: tag and path
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    parts: list[str] = []
    linked, in_link, at, end = 0, 0, 0, len(html)
    inline, depth = "", 0  # an open inline element that is not the article's: its text is left out

    def last(tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags stands, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop()[0]].pop()

    def close() -> None:
        nonlocal linked, depth
        depth = 0
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                path = stack[-1][1] or "/#"
                blocks.append((slots.setdefault(path, len(slots)), text, min(linked, len(text))))
        linked = 0

    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and not depth:
            text = html[at:stop]
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if depth and tag == inline:
            depth += -1 if m[1] else 1
            if not depth:
                parts.append(" ")
            continue
        if m[1]:  # an end tag
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                i = last((tag,))
                if i:
                    close()
                    cut(i)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                e = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = e.end() if e else end
            parts.append(" ")
        elif tag not in BLOCKS and tag not in VOID and m[3] and not m[3].endswith("/") and _label(tag, m[3])[-1] in "!?" and _label(tag, m[3])[-2:] != "~?":
            if not depth:
                inline, depth = tag, 1
        elif tag == "a":
            in_link = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag == "hr":
            close()
            if tag in CLOSES_P:
                i = last(("p",))
                if i > last(P_SCOPE):
                    cut(i)
            if tag in CLOSES_SAME:
                i = last(CLOSES_SAME[tag])
                if i > last(SCOPE[tag]):
                    while stack[i - 1][0] in CLOSES_SAME[tag]:
                        i -= 1
                    cut(i)
            if tag == "body" and stack[-1][0] == "head":
                cut(len(stack) - 1)
            if tag not in VOID:
                path, label = stack[-1][1], _label(tag, m[3])
                if len(stack) <= DEEPEST or (label[-1] in "!?" and path[-1:] not in ("!", label[-1])):
                    path = f"{path}/{label}"
                slots.setdefault(path, len(slots))
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, path))
    close()
    return list(slots), blocks


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("links", pa.int32())]))
    for batch in batches:
        trees, rows = [], []
        for html in batch.column("html").to_pylist():
            slots, blocks = parse(html or "")
            trees.append("\n".join(slots))
            rows.append([{"slot": s, "text": t, "links": n} for s, t, n in blocks])
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(trees, pa.string()), pa.array(rows, kind)],
            names=["page_id", "url", "host", "tree", "blocks"])


def match(a: list[str], b: list[str]) -> dict[int, int]:
    """Simple tree matching of two trees given by their slots' paths: pairs of slots
    of a maximum order-preserving match in which parents match and labels are equal.

    Siblings differ in label, so nodes match only at equal paths, and of a node's
    children the heaviest run that ascends in both trees is the maximum match. It is
    found by a list of best ends, so wide nodes cost n log n steps."""
    ib = {p: i for i, p in enumerate(b)}
    common: dict[str, list[str]] = {}  # of each path, its children in both trees, as in a
    for p in a:
        if p in ib:
            common.setdefault(p.rpartition("/")[0], []).append(p)
    weight: dict[str, int] = {}
    chosen: dict[str, list[str]] = {}
    for parent in sorted(common, key=lambda p: -p.count("/")):
        places: list[int] = []  # ends of runs by place in b, with rising totals
        totals: list[int] = []
        ends: list[tuple[str, object]] = []  # a run: its last child and the run before
        for child in common[parent]:
            k = bisect_right(places, ib[child])
            total = 1 + weight.get(child, 0) + (totals[k - 1] if k else 0)
            run = (child, ends[k - 1] if k else None)
            stop = k
            while stop < len(totals) and totals[stop] <= total:
                stop += 1
            places[k:stop], totals[k:stop], ends[k:stop] = [ib[child]], [total], [run]
        weight[parent] = totals[-1]
        run, kept = ends[-1], []
        while run:
            kept.append(run[0])
            run = run[1]
        chosen[parent] = kept
    ia = {p: i for i, p in enumerate(a)}
    out, todo = {}, [""]
    while todo:
        for p in chosen.get(todo.pop(), []):
            out[ia[p]] = ib[p]
            todo.append(p)
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slot of each distinct tree: the host's slot it is, and what its path says.

    Ranks: 0 in an article or main element, 1 in one below an element that only a
    name or a form leaves out, 2 in no such element, 3 left out by a name or form, 4
    left out. ``bare`` says that the tree has no article or main element. A slot that the
    reference lacks is known by its path."""
    for batch in batches:
        out = [[], [], [], [], [], [], []]
        for host, tree, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "reference"))):
            paths = tree.split("\n") if tree else []
            articles = any(re.match(r"(article|main)\b(?!.*[!?])", x) for path in paths if "!" not in path for x in path.split("/"))
            pairs = match(paths, reference.split("\n") if reference else [])
            for i, path in enumerate(paths):
                labels = path.split("/")
                inside = [k for k, x in enumerate(labels) if re.match(r"(article|main)\b(?!.*[!?])", x)]
                heads = [k for k, x in enumerate(labels) if re.match(r"header\b", x)]
                # a header is the page's unless it stands in an article
                outside = any(not any(re.match(r"article\b", y) for y in labels[:k]) for k in heads)
                soft = [k for k, x in enumerate(labels) if x.endswith("?") and not (inside and k > inside[0] and x.endswith("~?"))]
                if outside or any(x.endswith("!") for x in labels):
                    rank = 4
                elif not soft:
                    rank = 0 if inside else 2
                elif inside and soft[-1] < inside[0]:
                    rank = 1
                else:
                    rank = 3 if inside or not articles else 4
                own = f"{pairs[i]}" if i in pairs else path
                for column, value in zip(out, (host, tree, i, own, rank, bool(inside), not articles)):
                    column.append(value)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
                                         names=["host", "tree", "slot", "shared", "rank", "inside", "bare"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, blocks`` (``blocks`` are the kept ones).

    ``text`` joins the kept blocks in page order by one newline; it is empty for a
    page that is null, empty or has no article. Pages of a null or unreadable url
    form one host. Where a page has an article or main element only its blocks
    count. A constant slot is template if the host has LEAST_PAGES distinct pages
    with it and the host's other kept slots do vary; a constant block of a varying slot
    is so where the page has no article element. Copies of one page, equal in all
    their text, count once there; each row has its text.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "wrapper")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          host.alias("host"), F.col(html_col).cast("string").alias("html"))
    parsed = scratch.write(source.mapInArrow(_parse_pages, _PARSED))

    trees = scratch.write(parsed.groupBy("host", "tree").agg(F.count("*").alias("pages")))
    reference = trees.groupBy("host").agg(F.max(F.struct("pages", "tree"))["tree"].alias("reference"))
    aligned = scratch.write(trees.join(reference, "host").select("host", "tree", "reference").repartition("host", "tree")
                            .mapInArrow(_align, "host string, tree string, slot int, shared string, rank int, inside boolean, bare boolean"))

    # per page and slot, then per slot of the host: is the text always the same, how much of it is links
    on_page = parsed.select("host", "tree", F.explode(F.expr(
        "transform(array_distinct(blocks.slot), s -> named_struct('slot', s, 'own', filter(blocks, b -> b.slot = s)))")).alias("x"))
    seen = on_page.select("host", "tree", F.col("x.slot").alias("slot"),
                          F.xxhash64(F.col("x.own.text")).alias("hash"),
                          F.expr("aggregate(x.own, 0L, (n, b) -> n + length(b.text))").alias("chars"),
                          F.expr("aggregate(x.own, 0L, (n, b) -> n + b.links)").alias("links"))
    # copies of one page count once: the distinct pages (by all their text) in which the slot has text
    tree_key = [F.xxhash64("host", "tree").alias("tree_key"), F.hash("tree", "host").alias("tree_check")]
    on_pages = parsed.select(*tree_key, F.xxhash64("blocks.text").alias("page"), F.explode(F.array_distinct("blocks.slot")).alias("slot"))
    distinct = scratch.write(on_pages.distinct().groupBy("tree_key", "tree_check", "slot").agg(F.count("*").alias("pages")))
    by_tree = scratch.write(seen.groupBy("host", "tree", "slot").agg(
        F.min("hash").alias("low"), F.max("hash").alias("high"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links")))
    slots = aligned.join(by_tree, ["host", "tree", "slot"]).select("*", *tree_key).join(distinct, ["tree_key", "tree_check", "slot"])
    per_slot = slots.groupBy("host", "shared").agg(
        F.sum("pages").alias("pages"), (F.min("low") == F.max("high")).alias("same"),
        (F.sum("links") >= LINK_SHARE * F.sum("chars")).alias("menu"), (F.max("rank") >= 3).alias("out"),
        F.max("inside").alias("inside"))
    per_slot = scratch.write(per_slot)
    varied = per_slot.filter("not same and not out and not menu").groupBy("host").agg(F.max("inside").alias("varies"))
    judged = per_slot.join(varied, "host", "left")
    template = F.col("same") & (F.col("pages") >= LEAST_PAGES) & F.coalesce(F.col("varies") | ~F.col("inside"), F.lit(False))
    constant = F.col("same") & (F.col("pages") >= LEAST_PAGES)
    judged = judged.select("host", "shared", template.alias("template"), constant.alias("constant"), "menu")
    kept = slots.join(judged, ["host", "shared"])
    kept = kept.filter((F.col("rank") < 4) & ~F.when(F.col("rank") == 3, F.col("constant")).otherwise(F.col("template"))
                       & (~F.col("menu") | F.col("inside")))
    # of a tree's slots those of the least rank it has
    kept = kept.groupBy("host", "tree").agg(
        *[F.collect_set(F.when(F.col("rank") == r, F.col("slot"))).alias(f"rank{r}") for r in range(4)])
    constant_blocks = scratch.write(_constant_blocks(parsed, slots, per_slot, tree_key, scratch))
    kept = scratch.write(kept.join(constant_blocks, ["host", "tree"], "left"))

    width = kept.agg(F.max(F.octet_length("tree") + F.octet_length("host") + 16 * F.coalesce(F.size("constants"), F.lit(0))
                           + sum(8 * F.size(f"rank{r}") for r in range(4)))).first()[0] or 0
    rows = sized_join(parsed, kept, ["host", "tree"], "left", 64 + width)
    chosen = F.coalesce(*[F.when(F.size(f"rank{r}") > 0, F.col(f"rank{r}")) for r in range(4)])
    rows = rows.select("page_id", "url", "blocks", "constants", F.coalesce(chosen, F.expr("cast(array() as array<int>)")).alias("chosen"))
    blocks = F.expr("""transform(filter(blocks, b -> array_contains(chosen, b.slot) and not coalesce(array_contains(
        constants, named_struct('slot', b.slot, 'hash', xxhash64(b.text))), false)), b -> b.text)""")
    rows = rows.select("page_id", "url", blocks.alias("blocks"))
    return rows.select("page_id", "url", F.array_join("blocks", "\n").alias("text"), "blocks")


def _constant_blocks(parsed: DataFrame, slots: DataFrame, per_slot: DataFrame, tree_key: list[Column], scratch: Scratch) -> DataFrame:
    """Of each tree without an article, the blocks (slot and text hash) that are template
    though their slot varies: on LEAST_PAGES distinct pages and on more than BLOCK_SHARE
    of those on which the host's slot has text. A slot has fewer than 1 / BLOCK_SHARE
    times as many of them as blocks on a mean page, so the list of a tree is as short
    as its pages are."""
    open_slots = scratch.write(slots.filter("bare and rank < 4").join(per_slot.filter("not same").select("host", "shared"), ["host", "shared"])
                               .select("host", "tree", "tree_key", "tree_check", "slot", "shared"))
    lines = parsed.select(*tree_key, F.xxhash64("blocks.text").alias("page"), F.explode(F.array_distinct(F.expr(
        "transform(blocks, b -> named_struct('slot', b.slot, 'hash', xxhash64(b.text)))"))).alias("b"))
    lines = lines.select("tree_key", "tree_check", F.col("b.slot").alias("slot"), "page", F.col("b.hash").alias("hash"))
    width = open_slots.agg(F.max(F.octet_length("host") + F.octet_length("shared"))).first()[0] or 0
    lines = sized_join(lines, open_slots.drop("tree"), ["tree_key", "tree_check", "slot"], "inner", 64 + width)
    often = scratch.write(lines.select("host", "shared", "hash", "tree_key", "page").distinct()
                          .groupBy("host", "shared", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES))
    often = often.join(per_slot.select("host", "shared", "pages"), ["host", "shared"]).filter(F.col("n") > BLOCK_SHARE * F.col("pages"))
    return open_slots.join(often, ["host", "shared"]).groupBy("host", "tree").agg(
        F.collect_list(F.struct("slot", "hash")).alias("constants"))
