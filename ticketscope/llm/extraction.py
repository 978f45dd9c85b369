"""Main text of web pages by a site style tree.

The pages of a host are merged: an element is known by its path of tag, class and id names, and for each element the
tree counts which child layouts (presentation) and which texts (content) its pages show. The importance of an element is

    (1 - g**l) * entropy of its layouts + g**l * entropy of its texts, both over log(pages)

with l layouts; an element seen on one page has importance one. Pages of a host whose main text (before any cut) is the
same are copies and count once. Generic branches of low importance, which look and read alike all over the site, are
removed from each page where their text is one that stands in at least two different main texts with enough other words
around it (`Settings.min_rest` of its own length), so neither a copied body nor an unusual text in a common box goes.
Scripts, hidden elements, navigation, footers, asides and headers outside an article are noise wherever they stand; the
tree judges them too. Other elements that look like noise are suspects, decided when the whole page has been read: a
form, or a branch all of whose names are known ones for noise, goes unless it holds most of the page's text; a branch
named for comments goes where there is other text; a name that only contains such a word, or a discussion, goes where
its text is mostly links or, for a discussion, made of repeated entries. All other branches are the tree's. Where a page has an article (or else a main) element with text, only that is read, else the whole body; the cuts apply
inside all three. An article or main element whose branches would all go is read whole.

Character references are decoded, white space inside a block (line breaks and table cells included) becomes one space,
blocks are joined by one line feed, and nothing else is dropped. Null and empty pages give an empty text. Pages without
a host are not merged. Repeated rows are extracted alike. An empty table gives an empty result. Pages may be long and
badly nested: one pass with an explicit stack reads them whole.
"""

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.storage import stored

# Fixed values of HTML: elements without an end, of flowing text, of raw text, and of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
FURNITURE = frozenset("nav footer aside menu button select object canvas head".split()) | RAW
FORMS = frozenset("form fieldset dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
JUDGED = frozenset("div section ul ol dl table center details figure nav footer aside header form menu".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SELF_CLOSING = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
CELLS = frozenset("td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Names that say what a branch is for; the second list yields to a name for content beside it.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsors sponsored promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers footnav masthead "
    "cookie cookies consent gdpr popup popups modal overlay newsletter subscribe subscription signup social share sharing sharebar "
    "related recommended recommendations pagination pager copyright login skip toolbar tagcloud trending".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
DISCUSSION = frozenset("discussion responses reactions feedback".split())
NOTICES = frozenset("notice notices alert banner".split())
NEUTRAL = frozenset(
    "box bar list lists item items container wrapper wrap inner outer section block blocks area left right top bottom center "
    "primary secondary site page global links link posts articles stories group row col column columns panel has is js"
    .split()
)
WEAK_NOISE = frozenset("header headers banner notice notices alert widget widgets form forms search toolbar topbar".split())
CONTENT = frozenset("content article post entry body main story text title page".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(frozen=True)
class Settings:
    weight: float = 0.9  # g
    threshold: float = 0.3
    min_pages: int = 4
    min_rest: float = 0.1  # other main text on the page, by the branch's own


@dataclass
class Element:
    tag: str
    path: str
    noise: bool
    first_block: int
    children: list[str] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)
    suspect: int = -1


@dataclass
class Block:
    text: str
    noise: bool
    article: bool
    main: bool
    cut: bool
    links: int
    suspects: tuple[int, ...]


# What is known of an element at its start tag: surely noise, noise unless it is most of the page, a form, reader
# comments if there is other text, a discussion if it repeats, noise if it is mostly links.
SURE, NAMED, FORM, COMMENT, TALK, PERHAPS = "sure", "named", "form", "comment", "talk", "perhaps"
MOST = {NAMED: 0.8, FORM: 0.5}  # share of the page's text above which a suspect is its body


def suspected(tag: str, attrs: dict[str, str], inside: bool) -> str:
    """What the element's tag, role and names say of it; `inside` an article, a header may hold its title."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return SURE
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return SURE
    if tag in ("html", "body", "main"):
        return ""
    role = attrs.get("role", "").lower()
    if tag in FORMS or role == "form":
        return FORM
    if role in ROLES:
        return SURE
    found = ""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name) if not w.isdigit()]
        known = set(words)
        if not known & (NOISE | COMMENTS | DISCUSSION | WEAK_NOISE):
            continue
        strange = known - NOISE - COMMENTS - DISCUSSION - WEAK_NOISE - NEUTRAL - CONTENT
        weak = known & WEAK_NOISE and not known & CONTENT and not (inside and "header" in known)
        if tag == "article" and not known <= COMMENTS | NEUTRAL:
            continue
        if known & COMMENTS and not strange:
            return COMMENT
        if not strange and (known & NOISE or weak or words[-1] in NOTICES):
            return NAMED
        if known & DISCUSSION and not strange:
            found = TALK
        elif known & (NOISE | COMMENTS) and not found:
            found = PERHAPS
    return found


def decided(kind: str, own: int, links: int, repeats: bool, total: int) -> bool:
    """Whether a suspect is noise, from the characters in it, in its links, and on the page."""
    linked, other = 2 * links > own, total - own
    if kind in MOST:
        return linked or own <= MOST[kind] * total
    if kind == COMMENT:
        return 10 * other >= own
    return linked or (kind == TALK and repeats and 10 * other >= own)


def parsed(page: str, cut: frozenset[int] = frozenset()) -> tuple[list[Block], list[tuple[int, int, int, bool, int, int]]]:
    """Blocks in page order, and (node, layout, text, open to judgement, first block, past the last) of block elements."""
    stack = [Element("", "", False, 0)]
    blocks: list[Block] = []
    nodes: list[tuple[int, int, int, bool, int, int]] = []
    text: list[str] = []
    state = {"noise": 0, "article": 0, "main": 0, "cut": 0, "link": 0, "linked": 0}
    suspects: list[tuple[str, bool]] = []  # kind, and whether its parts repeat
    open_suspects: list[int] = []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        links, state["linked"] = min(state["linked"], len(joined)), 0
        text.clear()
        if joined:
            noise = state["noise"] > 0 or (stack[-1].tag not in HEADINGS and any(e.tag == "header" for e in stack))
            blocks.append(Block(joined, noise, state["article"] > 0, state["main"] > 0, state["cut"] > 0, links, tuple(open_suspects)))

    def said(part: str) -> None:
        part = html.unescape(part)
        text.append(part)
        if state["link"]:
            state["linked"] += len(part)

    def push(tag: str, raw: str) -> None:
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        top = stack[-1]
        label = ".".join([tag, *sorted(attrs.get("class", "").split()), *(["#" + attrs["id"]] if attrs.get("id") else [])])
        n = top.seen[label] = top.seen.get(label, -1) + 1
        top.children.append(label)
        kind = suspected(tag, attrs, state["article"] + state["main"] > 0)
        new = Element(tag, f"{top.path}/{label}[{n}]", kind == SURE, len(blocks))
        if kind and kind != SURE:
            new.suspect = len(suspects)
            suspects.append((kind, False))
            open_suspects.append(new.suspect)
        stack.append(new)
        state["noise"] += new.noise
        state["article"] += tag == "article"
        state["main"] += tag == "main" or attrs.get("role") == "main"
        if tag in JUDGED and cut and xxhash.xxh64_intdigest(new.path) in cut:
            state["cut"] += 1
            new.tag = "\0" + tag  # marks that leaving it ends a cut

    def pop() -> None:
        done = stack.pop()
        cut_here, tag = done.tag[:1] == "\0", done.tag.lstrip("\0")
        state["noise"] -= done.noise
        state["article"] -= tag == "article"
        state["main"] = max(0, state["main"] - (tag == "main"))
        state["cut"] -= cut_here
        body = "\n".join(b.text for b in blocks[done.first_block :])
        judged = tag in JUDGED and not state["noise"]
        if done.suspect >= 0:
            open_suspects.remove(done.suspect)
            repeats = any(n > 0 for label, n in done.seen.items() if "." in label or label == "li" or label == "article")
            suspects[done.suspect] = (suspects[done.suspect][0], repeats)
        nodes.append((xxhash.xxh64_intdigest(done.path), xxhash.xxh64_intdigest(" ".join(done.children)), xxhash.xxh64_intdigest(body), judged, done.first_block, len(blocks)))

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            said(page[at:])
            break
        if found.start() > at:
            said(page[at : found.start()])
        at = found.end()
        tag = (found["name"] or found["name2"] or "").lower()
        if not tag:
            continue
        closing = bool(found["end"] if found["name"] else found["end2"])
        if tag in RAW:
            if not closing:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "a":
                state["link"] = 0 if closing else 1
            if tag == "img":
                text.append(" ")
            continue
        if tag in VOID or tag in CELLS:
            if tag == "hr":
                flush()
            text.append(" ")
            continue
        flush()
        if closing:
            if any(e.tag.lstrip("\0") == tag for e in stack):
                while stack[-1].tag.lstrip("\0") != tag:
                    pop()
                pop()
            continue
        if stack[-1].tag in CLOSED_BY_BLOCK or (tag in SELF_CLOSING and stack[-1].tag == tag):
            pop()
        push(tag, found["attrs"] if found["name"] else found["attrs2"])
    flush()
    while len(stack) > 1:
        pop()
    if suspects:
        own, linked, total = [0] * len(suspects), [0] * len(suspects), 0
        for block in blocks:
            if not block.noise:
                total += len(block.text)
                for i in block.suspects:
                    own[i] += len(block.text)
                    linked[i] += block.links
        gone = {i for i, (kind, repeats) in enumerate(suspects) if decided(kind, own[i], linked[i], repeats, total)}
        for block in blocks:
            block.noise = block.noise or not gone.isdisjoint(block.suspects)
    return blocks, nodes


def chosen(blocks: list[Block]) -> list[bool]:
    """Which blocks the page's own meaning leaves: those inside an article, else inside a main element, else all but noise."""
    kept = [not b.noise for b in blocks]
    for inside in ([b.article for b in blocks], [b.main for b in blocks]):
        both = [k and i for k, i in zip(kept, inside)]
        if any(both):
            return both
    return kept


def main_text(page: str | None, cut: frozenset[int] = frozenset()) -> str:
    """The text of one page without noise and without the branches `cut`."""
    blocks, _ = parsed(page or "", cut)
    main = [b for b, inside in zip(blocks, chosen(blocks)) if inside]
    kept = [b for b in main if not b.cut]
    if not kept and any(b.article or b.main for b in main):
        kept = main
    return "\n".join(b.text for b in kept)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def judged_nodes(page: str, min_rest: float) -> Iterator[tuple[int, int, int, int, bool]]:
    """(main text, node, layout, text, open to judgement) of the elements of one page."""
    blocks, nodes = parsed(page)
    main = chosen(blocks)
    sizes = [0]
    for block, inside in zip(blocks, main):
        sizes.append(sizes[-1] + len(block.text) * inside)
    body = xxhash.xxh64_intdigest("\n".join(b.text for b, inside in zip(blocks, main) if inside))
    for node, layout, content, judged, first, last in nodes:
        own = sizes[last] - sizes[first]
        yield body, node, layout, content, judged and sizes[-1] - own >= min_rest * own


def elements(pages: DataFrame, settings: Settings) -> DataFrame:
    """(key, host, body, node, layout, content, judged) of the elements of (key, host, html)."""
    names = ["body", "node", "layout", "content"]
    shape = pa.schema([("key", pa.binary()), ("host", pa.string()), *((n, pa.int64()) for n in names), ("judged", pa.bool_())])
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, site, *map(signed, digests), judged)
                for key, site, page in zip(*(c.to_pylist() for c in batch.columns))
                for *digests, judged in judged_nodes(page or "", settings.min_rest)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, shape)], schema=shape)

    longs = ", ".join(f"{n} long" for n in names)
    return pages.select("key", "host", "html").mapInArrow(run, f"key binary, host string, {longs}, judged boolean")


def style_tree(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, node, pages, layouts, importance) of the merged elements."""
    counts = nodes.groupBy("host", "node", "layout", "content").agg(F.count(F.lit(1)).alias("n"))

    def entropy(column: str, into: str) -> DataFrame:
        sums = counts.groupBy("host", "node", column).agg(F.sum("n").alias("n"))
        total = sums.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("logs"))
        bits = F.log("pages") - F.col("logs") / F.col("pages")
        return total.select("host", "node", "pages", F.col("kinds").alias(f"{column}s"), F.when(F.col("pages") > 1, bits / F.log("pages")).otherwise(1.0).alias(into))

    both = entropy("layout", "presentation").join(entropy("content", "reading").drop("pages"), ["host", "node"])
    share = F.pow(F.lit(settings.weight), F.col("layouts"))
    importance = F.when(F.col("pages") > 1, (1 - share) * F.col("presentation") + share * F.col("reading")).otherwise(1.0)
    return both.select("host", "node", "pages", "layouts", importance.alias("importance"))


def extracted(pages: DataFrame, url: str = "url", page: str = "html", into: str = "text", settings: Settings = Settings()) -> DataFrame:
    """All columns and the main text; a column named like `into` is replaced."""
    empty = F.lit("")
    key = F.unhex(F.md5(F.concat(F.coalesce(pages[url].cast("string"), empty), F.lit("\n"), F.coalesce(pages[page].cast("string"), empty))))
    keyed = pages.select(key.alias("key"), host(pages[url]).alias("host"), pages[page].cast("string").alias("html"))
    nodes = stored(elements(keyed.filter("host <> ''"), settings), "elements")
    # One page speaks for all with its main text, so copies, and rows that repeat, count once.
    one = nodes.groupBy("host", "body").agg(F.min("key").alias("key"))
    different = stored(nodes.join(one.select("key"), "key", "left_semi").dropDuplicates(["host", "body", "node"]), "different-elements")
    low = style_tree(different, settings).filter((F.col("importance") < settings.threshold) & (F.col("pages") >= settings.min_pages))
    alike = different.filter("judged").groupBy("host", "node", "content").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    alike = alike.join(low.select("host", "node"), ["host", "node"], "left_semi")
    cuts = nodes.filter("judged").join(alike.drop("n"), ["host", "node", "content"], "left_semi")
    cuts = stored(cuts.groupBy("key").agg(F.collect_set("node").alias("__cut")), "cuts").withColumnRenamed("key", "__key")
    others = [c for c in pages.columns if c != into]
    whole = pages.select(*others, key.alias("__key")).join(cuts, "__key", "left").select(*others, "__cut")
    at = others.index(page)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [frozenset(x & ((1 << 64) - 1) for x in c or ()) for c in batch.column(len(others)).to_pylist()]
            texts = [main_text(p, c) for p, c in zip(batch.column(at).to_pylist(), cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, into])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*others).schema)
    return whole.mapInArrow(run, f"{shape}, `{into}` string")
