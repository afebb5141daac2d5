"""Main-text extraction with a site style tree.

Each page is read once into blocks: the text of a paragraph, heading, list item and so on, with the style path of the
elements around it (tag and classes, digits made equal). An inline element whose name tells of boilerplate is a part of its
block with a style of its own. Pages of one host are merged by style path. For each node of that tree

* content importance is 1 minus the mean entropy of its texts over pages: a text that stands on n of the node's m pages
  has entropy log n / log m, so boilerplate comes near 0 and text of one page near 1;
* presentation importance is the entropy of its child sequences, base m: a fixed menu 0, a varying article near 1.

Copies of a page within a host count as one page, so that they do not make its text look like boilerplate. A leaf's importance
is GAMMA times its content's and 1 - GAMMA times its parent's presentation.

What is low differs between hosts: a menu drawn from a long list of links has 0.7 where a fixed one has 0. So each host has a
limit of its own, in the widest gap between the importances of its branches, or, where none is wide, in the first gap below
its best branches. A branch's score is its distance to the limit, 1 at the gap's upper edge and -1 at its lower one. Names and
position are a prior, added to the score; most of it counts as some pages and so wears off on branches that many pages have
(see PRIORS). Branches with a score below 0 are removed, and the remaining blocks are joined in page order.

Names are of two kinds. A name tells by its last word, after words for containers: "cookie-notice" and "comments-area" do,
"notice-board" and "related-work" do not.

* Words that name parts of a template (menu, sidebar, banner, notice, share ...) or of discussions (reply ...) are a prior
  that wears off.
* Adverts, reader comments and teasers vary as articles do, so entropy cannot tell them: their names (VARIED_WORDS), tags that
  mean what they say (nav, footer, aside, form ...), and any name outside the article of a page that has one, have a prior
  that does not.

Names of html, body, article and main are no such names, nor is a header in an article; an article in a named branch is an
article, unless its own name agrees. Where branches with such words hold most of a page without article, the words tell
nothing there.

The tree speaks for branches that SUPPORT pages of a host have, as one list of its decisions for each host; for all others
the prior alone does. Classes that are made up for each page are not listed, so a list grows with a site's templates. Spark
broadcasts the lists while they are small and otherwise joins by host.

Defined cases: null or empty html gives the empty text; pages whose url is null or malformed are one host; repeated pages
each get a row; equal pages are equal; a page is read in time linear in its length, whatever is in it (a tag whose quotes
never close ends at the next ">", and from there on quotes mean nothing; beyond DEEP characters a path keeps a hash of what
is above), and in bounded parts of a batch; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import materialize, text_or_empty

GAMMA = 0.9
#: Pages that a branch needs for the tree to speak; a gap that is wide; the least gap; importance of a host's best branches.
SUPPORT, WIDE_GAP, LEAST_GAP, BEST = 8, 0.3, 0.03, 0.8
#: For hosts without a gap: half a gap, and the distance of the limit from the best branch.
PLAIN_HALF = 0.1
#: By standing (see blocks): what is added to a branch's score, for good and as a number of pages that its own pages outweigh.
PRIORS = {"m": (0.6, 10), "p": (0.0, 8), "o": (-0.5, -8), "n": (-0.2, -20), "x": (-3.0, 0)}
#: What an article has without a name goes only below this importance too.
ARTICLE_LIMIT = 0.5
#: Characters of a style path, and of an element's names, beyond which a hash stands for them.
DEEP, LONG_NAME = 512, 128

#: Fixed values of HTML: elements that begin a new block, and those whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title "
    "tr ul".split()
)
HIDDEN = frozenset("script style noscript template iframe textarea select option button".split())  # the last four: form controls
#: An element of the key ends open elements of the value that are directly above it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN = frozenset({"article", "main"})
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
NOISE_TAGS = frozenset({"head", "nav", "footer", "aside", "form", "menu", "dialog"})
#: Words in class, id or role that name parts of a template, those that name what varies without being the article, and
#: those for containers.
TEMPLATE_WORDS = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget cookie cookies consent notice "
    "notices gdpr popup modal overlay newsletter subscribe signup login share sharing social reply replies respond".split()
)
VARIED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion related recommended comment comments disqus".split()
)
CONTAINER_WORDS = frozenset(
    "area articles bar block body bottom box buttons container content form group inner item items left links list main outer "
    "panel posts right row section slot stories text thread top unit wrap wrapper".split()
)
#: Pages, and characters of their html, that become one batch.
BATCH_PAGES, BATCH_CHARACTERS = 500, 1 << 21

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^\W_]+")

#: How a branch is named for boilerplate: not at all, by a word of a template, by a word of what varies, by its tag.
UNNAMED, BY_WORD, BY_VARIED, BY_TAG = range(4)


def _named(names: Iterable[str], main: bool) -> int:
    """How names tell of boilerplate, inside an article (main) or not: by their last word, after words for containers."""
    found = UNNAMED
    for name in names:
        parts = _PARTS.findall(name)
        while len(parts) > 1 and (parts[-1] in CONTAINER_WORDS or parts[-1].isdigit()):
            parts.pop()
        head = parts[-1] if parts else ""
        if head in VARIED_WORDS or head in TEMPLATE_WORDS and not VARIED_WORDS.isdisjoint(parts):
            return BY_VARIED
        if head in TEMPLATE_WORDS and not (main and head == "header"):
            found = BY_WORD
    return found


def _style(tag: str, attributes: str, main: bool) -> tuple[str, int]:
    """An element's part of the style path, and how it is named for boilerplate; main is whether it is inside an article."""
    names = sorted({n for m in _NAMES.findall(attributes) for n in "".join(m).lower().split()}) if attributes else []
    named = BY_TAG if tag in NOISE_TAGS else UNNAMED if tag in ("html", "body") else _named(names, main)
    if tag == "header" and not main:
        named = max(named, BY_WORD)
    listed = " ".join(names).replace("/", "|")
    if len(listed) > LONG_NAME:
        listed = f"#{xxhash.xxh64_hexdigest(listed.encode('utf-8', 'surrogatepass'))}"
    return re.sub(r"\d+", "0", f"{tag[:LONG_NAME]}.{listed}" if listed else tag[:LONG_NAME]), named


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of each tag; comments, declarations and whole elements whose content is no text
    have the tag "". Any html in linear time."""
    lo, last, quotes = 0, html.rfind(">"), True
    while (at := html.find("<", lo)) >= 0:
        lo = at + 1
        if html.startswith("<!--", at):
            end = html.find("-->", at)
            lo = len(html) if end < 0 else end + 3
            yield at, lo, False, "", ""
        elif at > last:
            continue
        elif m := _NAME.match(html, at):
            found = _ATTRIBUTES.match(html, m.end()) if quotes else None
            if found is None:
                quotes, end = False, html.find(">", m.end())
            else:
                end = found.end() - 1
            lo = end + 1
            closing, tag, attributes = bool(m[1]), m[2].lower(), html[m.end() : end]
            if tag in HIDDEN:
                if not closing and not attributes.endswith("/"):
                    ended = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, lo)
                    lo = html.find(">", ended.end()) + 1 if ended and ended.end() <= last else len(html)
                tag = ""
            yield at, lo, closing, tag, attributes
        elif html[at + 1 : at + 2] in ("!", "?", "/"):
            lo = html.find(">", at) + 1
            yield at, lo, False, "", ""


@dataclass
class _Open:
    """An element that is open: its tag, path, how it is named, and whether it is inside an article. An inline element has
    the number of blocks that are open around it, and counts in `inner` the open elements of its tag inside without a path."""

    tag: str
    path: str
    noise: int = UNNAMED
    main: bool = False
    around: int = 0
    inner: int = 0

    @property
    def prefix(self) -> str:
        """The first part of its children's paths: a hash where its path is long, so that deep pages have short paths."""
        return self.path if len(self.path) <= DEEP else f"#{xxhash.xxh64_hexdigest(self.path.encode('utf-8', 'surrogatepass'))}"


def page_blocks(html: str) -> tuple[list[list[tuple[str, str]]], dict[str, str]]:
    """Blocks in page order, each a list of parts (style path, text), and the child sequence of each path. Only inline
    elements that are named for boilerplate make a part of their own. A path begins with its standing: "x" named for
    boilerplate for good (by tag, by a varied word, or outside the article of a page that has one), "n" by a word of a
    template elsewhere, "m" inside an article, "o" outside it on a page that has one, "p" on any other page."""
    found: list[list[tuple[int, bool, str, str]]] = []
    children: dict[str, list[str]] = {}
    stack = [_Open("", "")]
    block_places = [0]  # of the open blocks in the stack; the others are inline
    open_blocks: Counter[str] = Counter()
    open_inline: dict[str, list[_Open]] = {}
    block: list[tuple[int, bool, str, str]] = []
    text: list[str] = []
    lo, has_main = 0, False

    def part() -> None:
        """Ends a part of the block."""
        if text:
            raw = unescape("".join(text))
            text.clear()
            if words := raw.split():
                top = stack[-1]
                block.append((top.noise, top.main, top.path, " " * raw[0].isspace() + " ".join(words) + " " * raw[-1].isspace()))
            elif block and raw:
                block[-1] = (*block[-1][:3], f"{block[-1][3].rstrip()} ")

    def flush() -> None:
        part()
        if block:
            found.append(block[:])
            block.clear()

    def push(top: _Open) -> None:
        if top.around:
            open_inline.setdefault(top.tag, []).append(top)
        else:
            block_places.append(len(stack))
            open_blocks[top.tag] += 1
        stack.append(top)

    def pop() -> _Open:
        top = stack.pop()
        if top.around:
            open_inline[top.tag].pop()
        else:
            block_places.pop()
            open_blocks[top.tag] -= 1
        return top

    for at, end, closing, tag, attributes in tags(html):
        text.append(html[lo:at])
        lo = end
        if tag == "br":
            text.append(" ")
        elif tag in BLOCKS or tag == "hr":
            flush()
            if closing:
                while open_blocks[tag]:
                    if (top := pop()).tag == tag and not top.around:
                        break
            elif tag != "hr":
                while (own := stack[block_places[-1]]).tag == "p" or own.tag in ENDS.get(tag, ()):
                    while pop() is not own:
                        pass
                top = stack[-1]
                style, named = _style(tag, attributes, top.main)
                children.setdefault(top.prefix, []).append(style)
                noise, main = max(top.noise, named), top.main
                if tag in MAIN:
                    # A name of its own or above it does not tell, both do; inside an article, a named branch stays named.
                    noise = top.noise if main or named else UNNAMED
                    has_main |= not noise
                    main = main or not noise
                push(_Open(tag, f"{top.prefix}/{style}", noise, main))
        elif tag:
            named = open_inline.get(tag)
            inside = named[-1] if named and named[-1].around == len(block_places) else None
            if closing:
                if inside and inside.inner:
                    inside.inner -= 1
                elif inside:
                    part()
                    while pop() is not inside:
                        pass
            elif tag not in VOID and not attributes.endswith("/"):
                style, how = _style(tag, attributes, stack[-1].main) if attributes else ("", UNNAMED)
                if how:
                    part()
                    push(_Open(tag, f"{stack[-1].prefix}/{style}", max(stack[-1].noise, how), stack[-1].main, len(block_places)))
                elif inside:
                    inside.inner += 1
    text.append(html[lo:])
    flush()
    if not has_main:
        size = lambda kinds: sum(len(t) for b in found for n, _, _, t in b if n in kinds)
        if 2 * size((BY_WORD, BY_VARIED)) > size((UNNAMED, BY_WORD, BY_VARIED)):
            found = [[(UNNAMED if n in (BY_WORD, BY_VARIED) else n, *x) for n, *x in b] for b in found]
    branch = lambda n, main: "x" if n > BY_WORD or has_main and not main else "n"
    standing = lambda n, main: branch(n, main) if n else "m" if main else "o" if has_main else "p"
    return [[(f"{standing(n, main)}{path}", t) for n, main, path, t in _trimmed(b)] for b in found], {p: " ".join(c) for p, c in children.items()}


def blocks(html: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """page_blocks() with all parts side by side."""
    found, children = page_blocks(html)
    return [(path, text.strip(" ")) for block in found for path, text in block], children


def _trimmed(block: list[tuple[int, bool, str, str]]) -> list[tuple[int, bool, str, str]]:
    """A block without white space at its ends."""
    first, last = (*block[0][:3], block[0][3].lstrip(" ")), (*block[-1][:3], block[-1][3].rstrip(" "))
    return [first, *block[1:-1], last] if len(block) > 1 else [(*first[:3], first[3].rstrip(" "))]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PARSED = "blocks array<array<struct<path: string, text: string>>>, host string, page bigint, nodes array<struct<path: string, kind: string, feature: bigint, first: boolean>>"


def parse(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Every page with its blocks, its host, a hash of its article (or of all its texts), and what it adds to the host's
    tree: each text of a path ("c") and the child sequence of a path ("s") once, `first` on one row per path and kind."""
    source = df.select(F.col(key), F.col(url), text_or_empty(html).alias("_html"))
    names = [key, url, "blocks", "host", "page", "nodes"]
    node = pa.struct([("path", pa.string()), ("kind", pa.string()), ("feature", pa.int64()), ("first", pa.bool_())])
    kinds = [pa.list_(pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))), pa.string(), pa.int64(), pa.list_(node)]

    def one(address: str | None, page: str) -> tuple:
        read, sequences = page_blocks(page)
        own = [(path, text.strip(" ")) for block in read for path, text in block]
        nodes, seen = [], set()
        for path, text in own:
            feature = xxhash.xxh64_intdigest(text.encode('utf-8', 'surrogatepass')) - (1 << 63)
            if (path, feature) not in seen:
                nodes.append({"path": path[1:], "kind": "c", "feature": feature, "first": path not in seen})
                seen |= {path, (path, feature)}
        nodes += [{"path": p, "kind": "s", "feature": xxhash.xxh64_intdigest(c.encode()) - (1 << 63), "first": True} for p, c in sequences.items()]
        article = "\n".join([t for p, t in own if p[0] == "m"] or [t for _, t in own])
        parts = [[{"path": p, "text": t} for p, t in block] for block in read]
        return parts, host_of(address), xxhash.xxh64_intdigest(article.encode()) - (1 << 63), nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, rows = 0, 0, []
            for i, (address, page) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                html = str(page.as_py())
                rows.append(one(address.as_py(), html))
                size += len(html)
                if size >= BATCH_CHARACTERS or len(rows) >= BATCH_PAGES or i + 1 == batch.num_rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.record_batch([batch.column(c).slice(lo, len(rows)) for c in (0, 1)] + made, names)
                    lo, size, rows = i + 1, 0, []

    schema = T.StructType([source.schema[key], source.schema[url], *T._parse_datatype_string(_PARSED).fields])
    return source.mapInArrow(run, schema)


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the tree's leaves, from all pages of each host."""
    copies = parsed.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1")
    weighed = parsed.select("host", "page", "nodes").join(materialize(copies, "copies"), ["host", "page"], "left")
    nodes = weighed.select("host", (1 / F.coalesce("copies", F.lit(1))).alias("share"), F.inline("nodes"))
    counted = nodes.groupBy("host", "path", "kind", "feature").agg(
        F.greatest(F.round(F.sum("share"), 6), F.lit(1.0)).alias("n"), F.sum(F.when(F.col("first"), F.col("share")).otherwise(0.0)).alias("f")
    )
    stats = counted.groupBy("host", "path", "kind").agg(
        F.round(F.sum("f"), 6).alias("m"), F.avg(F.log("n")).alias("mean_log"), F.sum(F.col("n") * F.log("n")).alias("n_log")
    )
    m = F.col("m")
    stats = stats.select(
        "host",
        "path",
        "kind",
        "m",
        F.when(m <= 1, F.lit(1.0)).when(F.col("kind") == "c", 1 - F.col("mean_log") / F.log(m)).otherwise(1 - F.col("n_log") / (m * F.log(m))).alias("own"),
    )
    stats = materialize(stats, "style-tree")
    above = stats.where("kind = 's'").select("host", F.col("path").alias("parent"), F.col("own").alias("shape"))
    leaves = stats.where("kind = 'c'").withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    importance = GAMMA * F.col("own") + (1 - GAMMA) * F.coalesce("shape", F.lit(1.0))
    return leaves.join(above, ["host", "parent"], "left").select("host", "path", F.col("m").alias("pages"), importance.alias("importance"))


def limits(leaves: DataFrame) -> DataFrame:
    """(host, limit, half): where each host's importances part, and half the gap there."""
    known = leaves.where((F.col("pages") >= SUPPORT) & ~F.col("path").rlike("/head(/|$)"))
    below = F.lag("importance").over(Window.partitionBy("host").orderBy("importance", "path"))
    gaps = known.withColumn("below", below).withColumn("gap", F.col("importance") - F.col("below")).where(F.col("importance") >= BEST)
    edges = F.struct("below", "importance")
    wide = F.max_by(F.when(F.col("gap") >= WIDE_GAP, edges), F.when(F.col("gap") >= WIDE_GAP, F.col("gap")))
    top = F.max_by(F.when(F.col("gap") >= LEAST_GAP, edges), F.when(F.col("gap") >= LEAST_GAP, F.col("importance")))
    found = gaps.groupBy("host").agg(F.coalesce(wide, top).alias("g"), F.max("importance").alias("best"))
    limit = F.coalesce((F.col("g.below") + F.col("g.importance")) / 2, F.col("best") - PLAIN_HALF)
    return found.select("host", limit.alias("limit"), F.coalesce((F.col("g.importance") - F.col("g.below")) / 2, F.lit(PLAIN_HALF)).alias("half"))


def _stays(standing: Column) -> Column:
    """Whether a branch stays. Where no branch of a host is important, all its texts repeat, and the prior alone decides."""
    of = lambda i: F.element_at(F.create_map(*[x for k, v in PRIORS.items() for x in (F.lit(k), F.lit(float(v[i])))]), standing)
    score = F.coalesce(F.greatest(F.least((F.col("importance") - F.col("limit")) / F.col("half"), F.lit(2.0)), F.lit(-2.0)), F.lit(0.0))
    return (score + of(0) + of(1) / F.col("pages") >= 0) | (standing == "m") & (F.col("importance") >= ARTICLE_LIMIT)


def exceptions(parsed: DataFrame, leaves: DataFrame) -> DataFrame:
    """(host, turned): the tree's decisions for the branches of each host, with their standing: "+" stays, "-" goes."""
    there = parsed.select("host", F.explode(F.flatten("blocks")).alias("b")).select("host", F.col("b.path").alias("branch")).distinct()
    branches = there.select("host", "branch", F.expr("substring(branch, 2)").alias("path"), F.substring("branch", 1, 1).alias("standing"))
    decided = branches.join(leaves.where(F.col("pages") >= SUPPORT), ["host", "path"]).join(limits(leaves), "host", "left")
    listed = F.concat(F.when(_stays(F.col("standing")), "+").otherwise("-"), "branch")
    # Hosts without any supported branch have an empty list.
    hosts = leaves.select("host").distinct().join(decided.groupBy("host").agg(F.collect_set(listed).alias("turned")), "host", "left")
    return hosts.select("host", F.coalesce("turned", F.array().cast("array<string>")).alias("turned"))


#: Standings whose branches stay where the tree does not speak.
KEPT = "mp"


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    parsed = materialize(parse(df, key, url, html), "blocks")
    leaves = materialize(style_tree(parsed), "leaves")
    listed = materialize(exceptions(parsed, leaves), "exceptions")
    placed = parsed.select(key, url, "host", "blocks").join(listed, "host", "left")
    says = lambda sign, b: F.array_contains("turned", F.concat(F.lit(sign), b["path"]))
    goes = lambda b: says("-", b) | ~says("+", b) & ~F.substr(b["path"], F.lit(1), F.lit(1)).isin(*KEPT)
    kept = lambda block: F.transform(F.filter(block, lambda b: F.coalesce(~goes(b), F.lit(True))), lambda b: b["text"])
    whole = lambda block: F.when(F.size(block) == 1, F.array_join(kept(block), "")).otherwise(F.trim(F.regexp_replace(F.array_join(kept(block), ""), " +", " ")))
    text = F.array_join(F.filter(F.transform("blocks", whole), lambda t: t != ""), "\n\n")
    return placed.select(key, url, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
