"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path (tags and classes from the root). A node's importance is the entropy of
its presentations over the pages, a text leaf's one minus the mean entropy of its contents over the pages, and a branch's a
mixture of its own importance and its children's. Branches of low importance look and read alike on every page: they are
removed from each page, as are branches whose markup says that they are no part of the article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, stored

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?:/?[a-zA-Z!?][^<>]*)?\Z|</?[a-zA-Z][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
TOKEN = re.compile(r"[a-z]+")
# Elements by what HTML says of them, and usual names of what surrounds an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = frozenset("nav footer aside form head menu dialog button label object canvas audio video".split())
ASIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription "
    "signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar related recommended share sharing social comment comments disqus reply replies respond "
    "search login pagination pager skip legal copyright toolbar alert dialog complementary contentinfo".split()
)
#: Of those, what makes even an article element none of the page's own.
OTHER_ARTICLE = frozenset("ad ads advert advertisement comment comments promo recommended related replies reply sponsored teaser".split())
# An opening tag of the key ends an open element of these, as HTML's parser does.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def names(attributes: str, aside_names: frozenset[str] = ASIDE_NAMES) -> tuple[str, bool]:
    """The class, for the path, and whether the markup says that this is no part of the article."""
    cls, aside = "", False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "class":
            cls = ".".join(sorted(value.split()))
        if key in ("class", "id", "role"):
            aside |= not aside_names.isdisjoint(TOKEN.findall(value))
        aside |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    return cls, aside


class Page:
    """blocks: [path's hash, ancestors' hashes, in article, set aside, text]; shapes: path's hash -> children's tags."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, tuple[int, ...], bool, bool, str]] = []
        self.shapes: dict[int, list[str]] = {}
        self.text: list[str] = []
        self.found = False
        #: tag, path, aside, in an article
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        at, skip = 0, ""
        for m in TAG.finditer(source):
            if skip and not (m[1] and m[2].lower() == skip):
                continue
            if not skip and m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if skip:
                skip = ""
            elif m[1]:
                self.close(tag)
            elif tag in RAW:
                skip = "" if m[3].endswith("/") else tag
            elif tag == "br":
                self.text.append(" ")
            elif tag not in VOID:
                self.open(tag, m[3])
        if not skip and at < len(source):
            self.text.append(source[at:])
        self.flush()

    def flush(self) -> None:
        if self.text:
            words = html.unescape("".join(self.text)).split()
            self.text = []
            if words:
                _, path, aside, inside = self.stack[-1]
                self.blocks.append((path, tuple(x[1] for x in self.stack[1:]), inside, aside, " ".join(words)))

    def open(self, tag: str, attributes: str) -> None:
        cls, aside = names(attributes, OTHER_ARTICLE if tag in ("article", "main") else ASIDE_NAMES) if attributes.strip() else ("", False)
        if tag not in BLOCK and not aside:  # inline: part of the block around it
            return
        self.flush()
        if tag in BLOCK and self.stack[-1][0] == "p":
            self.stack.pop()
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in CLOSES[tag]:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in ("ul", "ol", "dl", "table", "article", "body"):
                    break
        _, above, off, inside = self.stack[-1]
        path = xxhash.xxh64_intdigest(f"{above}>{tag}.{cls}", 3) >> 1
        self.shapes.setdefault(above, []).append(tag)
        self.shapes.setdefault(path, [])
        if tag in ("article", "main"):
            off &= self.found  # the first one counts whatever the wrappers around it are named
            self.found |= not aside
            inside = True
        off |= aside and tag not in ("html", "body") or tag in ASIDE_TAGS or (tag == "header" and not inside)
        self.stack.append((tag, path, off, inside))

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.flush()
                del self.stack[k:]
                return


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, above, feature, n): how many pages show a feature at a path; summed within a batch already.

    feature is a hash, even for contents and odd for presentations; path 0 counts the pages.
    """
    for batch in batches:
        seen: Counter = Counter()
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html")):
            page, site = Page(source.as_py() or ""), host(url)
            found = {(site, 0, 0, 0)}
            above: dict[int, int] = {}
            for path, chain, _, _, text in page.blocks:
                found.add((site, path, chain[-2] if len(chain) > 1 else 0, (xxhash.xxh64_intdigest(text.encode(), 5) >> 1) & ~1))
                above.update(zip(chain[1:], chain))
            for path, tags in page.shapes.items():
                if path:
                    found.add((site, path, above.get(path, 0), (xxhash.xxh64_intdigest(" ".join(dict.fromkeys(tags)), 6) >> 1) | 1))
            seen.update(found)
        cols = list(zip(*seen)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), *(pa.array(list(c), pa.int64()) for c in cols[1:]), pa.array(list(seen.values()), pa.int64())], ["host", "path", "above", "feature", "n"])


def _importance(mixing: float, low: float, prior: float):
    def run(table: pa.Table) -> pa.Table:
        """A host's tree, from the leaves up: composite importance of each branch; the low ones are returned."""
        rows = table.to_pylist()
        pages = next((r["shown"] for r in rows if r["path"] == 0), 1)
        own: dict[int, list[float]] = {}
        children: dict[int, set[int]] = {}
        for r in rows:
            if r["path"] == 0:
                continue
            if r["content"]:
                value = 1 - r["log_n"] / r["features"] / math.log(pages) if pages > 1 else 1.0
            else:
                value = (math.log(r["shown"]) - r["n_log_n"] / r["shown"]) / math.log(pages) if pages > 1 else 1.0
            own.setdefault(r["path"], []).append((r["content"], min(1.0, max(0.0, value))))
            children.setdefault(r["above"], set()).add(r["path"])
        done: dict[int, tuple[float, float]] = {}  # a branch's composite importance, and the largest in it
        todo, opened = list(own), set()
        while todo:
            p = todo.pop()
            if p in done:
                continue
            under = [c for c in children.get(p, ()) if c in own and c != p]
            if p not in opened:  # its children first
                opened.add(p)
                todo += [p, *(c for c in under if c not in opened)]
                continue
            texts = [v for content, v in own[p] if content]
            looks = min((v for content, v in own[p] if not content), default=1.0)
            parts = [done[c][0] for c in under if c in done]
            weight = mixing ** len(parts)
            inner = (1 - weight) * sum(parts) / len(parts) + weight * looks if parts else looks
            value = max(texts) if texts else inner
            done[p] = value, max([value, *(done[c][1] for c in under if c in done)])
        # A page or two say little: `prior` pages more, on which everything was different, are imagined.
        out = [p for p, (_, most) in done.items() if (pages * most + prior) / (pages + prior) < low]
        return pa.table({"host": pa.array([rows[0]["host"]] * len(out), pa.string()), "path": pa.array(out, pa.int64())})

    return run


def main_text(source: str, low: frozenset[int]) -> str:
    """The blocks outside the low branches and of what markup calls the article; all of these if each is in a low branch."""
    page = Page(source)
    article = any(b[2] and not b[3] for b in page.blocks)
    own = [(chain, text) for _, chain, inside, aside, text in page.blocks if not aside and (inside or not article)]
    return "\n".join([text for chain, text in own if low.isdisjoint(chain)] or [text for _, text in own])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "", frozenset(x.as_py() or ())) for h, x in zip(batch.column("html"), batch.column("low"))]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", mixing: float = 0.9, low: float = 0.05, prior: float = 0.2) -> DataFrame:
    """(id, url, text, n_chars) of every page: its main text, blocks joined by one newline.

    A branch is removed where its importance and all in it are under `low` on its host, `prior` imagined pages without it
    included, unless nothing would be left of a page (all of a host's pages may be copies); and, since boilerplate whose words
    differ on every page has a high entropy, where its element, class, id or role names it a menu, header, footer, sidebar,
    notice, advert, form or comments. Where a page marks an article, only that is taken. Null or empty html gives an empty text; pages without a host in their url form one
    site; a null url stays null. Repeated pages are all returned, empty tables give none, and other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    seen = rows.select("url", "html").mapInArrow(lean(_observe), "host string, path long, above long, feature long, n long")
    counts = seen.groupBy("host", "path", "above", "feature").agg(F.sum("n").alias("n"))
    kind = (F.col("feature") % 2 == 0).alias("content")
    nodes = counts.groupBy("host", "path", "above", kind).agg(
        F.sum("n").alias("shown"), F.count(F.lit(1)).alias("features"), F.sum(F.log("n")).alias("log_n"), F.sum(F.col("n") * F.log("n")).alias("n_log_n")
    )
    low_paths = nodes.groupBy("host").applyInArrow(_importance(mixing, low, prior), "host string, path long")
    low_paths = stored(low_paths.groupBy("host").agg(F.collect_set("path").alias("low")).withColumnRenamed("host", "_host"), "sitetree")
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = rows.withColumn("_site", site).join(low_paths, F.col("_site") == F.col("_host"), "left").select("_id", "url", "html", "low")
    return joined.mapInArrow(lean(_apply), f"_id {rows.schema['_id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("_id", id_col)


def op3_sitetree(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
