"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree: elements of the same tag, class and id below the
same parent are one node. A node's presentation importance is the entropy of the child
sequences it shows, its content importance one less the mean entropy of its texts over the
pages. A branch goes when the nodes that own its texts have a low importance beside the node
that holds most of the host's text: what a template repeats goes, what differs from page
to page stays. Markup that names its purpose settles the importance before: menus, forms
and the like have none, and where a page marks its article the rest of the page has none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loreweave.llm.common import table
from loreweave.session import durable

#: Share of the presentation in an inner node's importance, by child sequences.
GAMMA = 0.9
#: A node is noise below this share of the importance of the host's largest node, on at
#: least so many pages.
LEAST, PAGES = 0.4, 3

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NEVER = frozenset(
    """head title script style noscript noembed noframes template xmp iframe object embed svg canvas audio video
    nav footer aside form button select datalist input textarea dialog menu""".split()
)
BLOCK = frozenset(
    """html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul""".split()
)
#: A start tag of the first kind ends an open element of the second, not looking past the third.
ENDS = {t: (frozenset(["p"]), frozenset("td th caption button object".split())) for t in BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}}
ENDS["li"] = (frozenset(["li", "p"]), frozenset("ul ol menu dir td th".split()))
ENDS["dd"] = ENDS["dt"] = (frozenset(["dd", "dt", "p"]), frozenset("dl td th".split()))
ENDS["td"] = ENDS["th"] = (frozenset(["td", "th"]), frozenset(["table"]))
ENDS["tr"] = (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"]))
ENDS["tbody"] = ENDS["thead"] = ENDS["tfoot"] = (frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"]))
ENDS["option"] = (frozenset(["option"]), frozenset(["select"]))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name parts beside an article.
BESIDE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs consent cookie cookies copyright
    footer gdpr header login masthead menu modal nav navbar navigation newsletter notice paywall pager pagination popup
    promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription toolbar topbar widget""".split()
)
TALK = frozenset("comment comments discussion disqus replies respond responses".split())
#: Words that say a name tells of the whole page, not of the part it names.
ABOUT = frozenset("has with without no not is layout page wrapper container body content main".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)|<(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'<]|"[^"<]*"|'[^'<]*'|"[^"]{0,2000}"|'[^']{0,2000}'|["'<])*?)>"""
    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

PARSED = "_row long, _host string, _blocks array<struct<node:long,text:string>>, _leaves array<struct<node:long,feature:long,n:int,chars:long,page:int>>, _styles array<struct<node:long,style:long,n:int>>"


def host(url: str | None) -> str | None:
    """The host of an address in lower case, without user and port; null if it has none."""
    found = _HOST.match(url or "")
    return found[1].lower() or None if found else None


@lru_cache(maxsize=1 << 16)
def _attributes(attrs: str) -> tuple[str, frozenset, bool, bool]:
    """Label of class and id without digits, words of the names, whether the element is a
    place of the main text, and whether it is hidden or has a role beside it."""
    if not attrs or attrs.isspace():
        return "", frozenset(), False, False
    label, words, scope, away = [], set(), False, False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            label += sorted(re.sub(r"\d+", "", x) for x in value.split())
            for x in value.split():
                parts = {w.lower() for w in _WORDS.findall(x)}
                words |= parts if not parts & ABOUT else parts & TALK - {"comment"} if not parts & {"no", "without"} else set()
        elif name == "role":
            scope |= value.lower() == "main"
            away |= value.lower() in ROLES
        elif name == "itemprop":
            scope |= value.lower() == "articlebody"
        elif name == "hidden":
            away = True
        elif name == "aria-hidden":
            away |= value.lower() == "true"
        else:
            away |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return ".".join(label), frozenset(words), scope, away


@lru_cache(maxsize=1 << 16)
def _node(parent: int, label: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{parent}/{label}"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Element:
    __slots__ = ("away", "children", "label", "node", "opened", "scope", "tag", "told")

    def __init__(self, tag, node, label, away, scope, told):
        self.tag, self.node, self.label, self.away, self.scope, self.told = tag, node, label, away, scope, told
        self.children, self.opened = 0, False


class Page:
    """Blocks, leaves and styles of one page.

    Unclosed, crossed and cut-off tags are read as browsers do: a block start ends an open
    paragraph, an end tag closes up to its start, one without a start is passed over.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[_Element, str]] = []
        self.styles: Counter = Counter()
        self.told: list[list] = []
        self.marked = False
        self.stack = [_Element("", 0, "", False, False, ())]
        self.buffer: list[str] = []
        self._read(html)
        self._choose()

    def _read(self, html: str) -> None:
        at = 0
        while True:
            found = _TAG.search(html, at)
            if found is None:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            if found["name"]:
                tag = found["name"].lower()
                self._start(tag, found["attrs"], html, at)
                if tag in RAW:
                    stop = _closing(tag).search(html, at)
                    at = stop.end() if stop else len(html)
                    self._end(tag)
            elif found["end"]:
                self._end(found["end"].lower())
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _text(self, raw: str) -> None:
        if not self.stack[-1].away:
            self.buffer.append(raw)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                owner = next(e for e in reversed(self.stack) if e.tag in BLOCK or e.tag == "")
                owner.opened = True
                self.blocks.append((owner, text))

    def _start(self, tag: str, attrs: str, html: str, at: int) -> None:
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        ended = ENDS.get(tag)
        if ended:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in ended[1]:
                    break
                if self.stack[i].tag in ended[0]:
                    self._cut(i)
                    if ended[0] == {"p"}:
                        break
        above = self.stack[-1]
        label, words, scope, away = _attributes(attrs)
        label = f"{tag}.{label}" if label else tag
        scope |= tag == "main" or (tag == "article" and not above.scope)
        away |= above.away or tag in NEVER or (tag == "header" and not above.scope)
        away |= tag == "article" and any(e.tag == "article" for e in self.stack)
        if tag == "form" and not above.away and away and _wraps(html, at):
            away = False
        told = above.told
        if not away and tag not in ("html", "body", "main", "article"):
            if words & (BESIDE | TALK):
                self.told.append([False, bool(words & TALK)])
                told = (*told, len(self.told) - 1)
        if scope and not away:
            self.marked = True
            for k in told:
                self.told[k][0] = True
        above.children = (above.children * 1_000_003 + _node(0, label)) & ((1 << 64) - 1)
        self.stack.append(_Element(tag, _node(above.node, label), label, away, scope or above.scope, told))

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self._text(" ")
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return

    def _cut(self, i: int) -> None:
        if any(e.tag in BLOCK for e in self.stack[i:]):
            self._flush()
        while len(self.stack) > i:
            self._pop()

    def _pop(self) -> None:
        e = self.stack.pop()
        if e.opened:
            self.styles[e.node, _signed(e.children)] += 1

    def _choose(self) -> None:
        """Drop what markup settles: parts beside the article that hold no part of it, and,
        where some text is marked as the article's, all other text."""
        total = sum(len(t) for _, t in self.blocks)
        sizes: Counter = Counter()
        for e, t in self.blocks:
            for k in e.told:
                sizes[k] += len(t)
        out = {k for k, (holds, talk) in enumerate(self.told) if talk or (not holds and (self.marked or 2 * sizes[k] <= total))}
        self.blocks = [(e, t) for e, t in self.blocks if not out.intersection(e.told)]
        if any(e.scope for e, _ in self.blocks):
            self.blocks = [(e, t) for e, t in self.blocks if e.scope]

    def leaves(self) -> list[dict]:
        """Distinct texts of each node, without case and digits, with their number and letters."""
        n: Counter = Counter()
        chars: Counter = Counter()
        for e, t in self.blocks:
            key = e.node, _signed(xxhash.xxh64_intdigest(re.sub(r"\d+", "0", t.lower())))
            n[key] += 1
            chars[key] += len(t)
        seen: set = set()
        return [{"node": node, "feature": f, "n": c, "chars": chars[node, f], "page": int(node not in seen and not seen.add(node))} for (node, f), c in n.items()]


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I)


def _wraps(html: str, at: int) -> bool:
    """Whether a form that starts here is put around the article."""
    end = _closing("form").search(html, at)
    return re.compile(r"<(?:article|main|h1)[\s>]", re.I).search(html, at, end.start() if end else len(html)) is not None


def parsed(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with the columns of ``PARSED`` in place of ``html``; stored."""
    given = pages.withColumn("_row", F.monotonically_increasing_id())
    schema = StructType([f for f in given.schema.fields if f.name not in ("html", "_row")] + StructType.fromDDL(PARSED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                read = [Page(h or "") for h in batch.column("html").to_pylist()]
                made = {
                    "_row": batch.column("_row"),
                    "_host": [host(u) for u in batch.column("url").to_pylist()],
                    "_blocks": [[{"node": e.node, "text": t} for e, t in p.blocks] for p in read],
                    "_leaves": [p.leaves() for p in read],
                    "_styles": [[{"node": k, "style": s, "n": n} for (k, s), n in p.styles.items()] for p in read],
                }
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x := made.get(f.name, None), pa.Array) else batch.column(f.name) if x is None else pa.array(x, f.type) for f in out], schema=out
                )

    return durable(given.mapInArrow(run, schema))


def importances(rows: DataFrame) -> DataFrame:
    """The tree of each host: ``(_host, node)`` with ``pages``, ``chars``, ``presentation``,
    ``content`` and their composite ``importance``.

    Counts per text and per child sequence are summed first, so a host with very many
    pages is spread over tasks. A node met on one page has importance 1.
    """
    entropy = lambda total, logs: F.log(total) - logs / total
    leaf = rows.filter("_host is not null").select("_host", F.explode("_leaves").alias("l")).select("_host", "l.*")
    texts = leaf.groupBy("_host", "node", "feature").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("logs"), F.sum("chars").alias("chars"), F.sum("page").alias("pages")
    )
    content = texts.groupBy("_host", "node").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.avg(entropy(F.col("n"), F.col("logs"))).alias("_mean")
    )
    style = rows.filter("_host is not null").select("_host", F.explode("_styles").alias("s")).select("_host", "s.*")
    shown = style.groupBy("_host", "node", "style").agg(F.sum("n").alias("n"))
    looks = shown.groupBy("_host", "node").agg(F.count(F.lit(1)).alias("looks"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.log("n")).alias("_logs"))
    share = F.pow(F.lit(GAMMA), F.col("looks"))
    return (
        content.join(looks, ["_host", "node"])
        .withColumn("content", F.when(F.col("pages") > 1, 1 - F.col("_mean") / F.log("pages")).otherwise(F.lit(1.0)))
        .withColumn("presentation", F.when(F.col("_n") > 1, entropy(F.col("_n"), F.col("_logs")) / F.log("_n")).otherwise(F.lit(1.0)))
        .withColumn("importance", F.when(F.col("pages") > 1, (1 - share) * F.col("presentation") + share * F.col("content")).otherwise(F.lit(1.0)))
        .select("_host", "node", "pages", "chars", "presentation", "content", "importance")
    )


def noise(tree: DataFrame) -> DataFrame:
    """``(_host, node)`` of the nodes whose texts go."""
    largest = tree.groupBy("_host").agg(F.max_by("importance", F.struct("chars", "node")).alias("_top"))
    return tree.join(largest, "_host").filter((F.col("pages") >= PAGES) & (F.col("importance") < LEAST * F.col("_top"))).select("_host", "node")


def extract(pages: DataFrame) -> DataFrame:
    """``pages(url, html, ...)`` with ``text`` in place of ``html``.

    Blocks of the article, trimmed, their white space (no-break spaces too) single blanks, joined by line
    breaks. A null or empty page, and one without article text, has an empty text. Pages
    without a host are judged by their markup alone. Repeated rows stay. Other columns
    are kept; a given ``text`` and names starting with ``_`` are reserved.
    """
    rows = parsed(pages.drop("text"))
    low = durable(noise(importances(rows)))
    met = rows.select("_row", "_host", F.explode(F.array_distinct(F.transform("_leaves", lambda x: x["node"]))).alias("node"))
    cut = durable(met.join(low, ["_host", "node"]).groupBy("_row").agg(F.collect_set("node").alias("_cut")))
    kept = F.filter("_blocks", lambda b: F.col("_cut").isNull() | ~F.array_contains("_cut", b["node"]))
    return (
        rows.drop("_leaves", "_styles", "_host")
        .join(cut, "_row", "left")
        .withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
        .drop("_row", "_blocks", "_cut")
    )


def op12(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
