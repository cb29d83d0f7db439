"""Main text of web pages: nearest-URL page differencing, guided by the page's own structure.

Each page is cut into lines (blocks of text). The different line lists of a host are sorted by URL path, and each is paired with
the neighbour whose path shares the longer beginning with its own. The pair's lines are aligned by longest common
subsequence; lines that both have are the site's, not the page's, and go.

Every page goes through that. Differencing alone would keep menus and adverts that change from page to page and drop article
lines that two pages share, so a check by structure follows: lines inside menus, headers, footers, sidebars, forms, notices,
adverts and reader comments go whatever the neighbour has, and where a page marks its article (or main part), all of the
article's lines stay and the lines around it go. On pages without such a mark differencing has the last word. A class or id
names such a part only if all its words do (``comment-list``, ``site-footer``), so an article's ``social-history`` stays.

Markup is parsed where the page is read, once, into a stored table of blocks of bounded bytes, bucketed by block: the
neighbours' answers go to the texts, which don't move again. Only line digests are sorted, one row per host and line list:
copies of a page share one row, and their neighbour is a page that differs. Parts of the sorted order hand their edge rows to
each other, so results do not depend on the number of parts, and a host with a third of all pages is many tasks' work.

Defined cases: null or empty html gives an empty text; a null URL has an empty host and path; broken and unclosed markup is
read as far as it goes. Rows may repeat, each gets a row, and copies on one host get the same text; null ids are carried
along. A page that is its host's only line list keeps its lines; pages without lines are nobody's neighbour. Other columns
are ignored.
"""

from __future__ import annotations

import os.path
import re
import uuid
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.shared import by_batch, shared_folder, slices, stored
from opinara.llm.url_filter import host_of, path_of

TOKEN = re.compile(
    r"(<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|(<[/!?A-Za-z][^>]*>?)|([^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "svg", "dialog", "object", "audio", "video", "canvas", "fieldset"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words in a class, id or role that mark what is not the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "paywall", "popup", "promo", "promoted", "recommended", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that may stand beside them in a name without making it another thing.
BESIDE = {
    "area", "bar", "block", "body", "bottom", "box", "container", "content", "footer", "form", "global", "header", "item", "left", "links", "list", "main",
    "mobile", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "thread", "top", "unit", "wrapper",
}
GONE, ARTICLE, OTHER = 0, 1, 2
#: Cells of an alignment that are held at once; longer lists are halved first.
CELLS = 1 << 27
#: Bytes of kept text in a block; a longer page is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of html in a bucket, up to 50,000 buckets.
BUCKET_BYTES = 32 << 20


def _marked(attributes: str) -> bool:
    """Whether a class, id or role consists of marking words, others beside them and numbers."""
    for _, value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            parts = {part.lower() for part in NAME_PART.findall(name) if not part.isdigit()}
            if parts & MARKS and parts <= MARKS | BESIDE:
                return True
    return False


def lines_of(html: str) -> list[tuple[str, int]]:
    """The page's lines in order, each GONE (in a menu, an advert ...), of the ARTICLE, or OTHER."""
    lines: list[tuple[str, int]] = []
    held: dict[int, list[str]] = {GONE: [], ARTICLE: [], OTHER: []}
    stack: list[tuple[str, bool, bool]] = []
    gone = article = 0

    def flush() -> None:
        for kind, texts in held.items():
            if texts:
                if line := " ".join("".join(texts).split()):
                    lines.append((line, kind))
                texts.clear()

    def pop_to(size: int) -> None:
        nonlocal gone, article
        while len(stack) > size:
            _, was_gone, was_article = stack.pop()
            gone -= was_gone
            article -= was_article

    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        _, slash, name, attributes, _, text = m.groups()
        if text is not None:
            held[GONE if gone else ARTICLE if article else OTHER].append(unescape(text) if "&" in text else text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            continue
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = close.end() if close else len(html)
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if name in VOID or attributes.endswith("/"):
            continue
        is_gone = name in DROPPED or name == "header" and not article or "=" in attributes and name not in ("html", "body", "main") and _marked(attributes)
        is_article = name in MAIN and not gone
        if is_gone or is_article or name not in ("p", "li", "b", "i", "a", "em", "strong", "tr", "td", "th", "dd", "dt", "option"):
            stack.append((name, bool(is_gone), is_article))
            gone += bool(is_gone)
            article += is_article
    flush()
    return lines


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit vectors over ``a``, one per item of ``b``: a zero where the longest common subsequence grows."""
    ones = (1 << len(a)) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    v, rows = ones, []
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & ones
        rows.append(v)
    return rows


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``b`` and the first 0, 1, ... items of ``a``, in little memory."""
    ones = (1 << len(a)) - 1
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)

    def mask(at: list[int]) -> int:
        bits = np.zeros(len(a), np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    often = {x: mask(at) for x, at in places.items() if len(at) > 64}
    v = ones
    for x in b:
        if x in places:
            u = v & (often[x] if x in often else sum(1 << i for i in places[x]))
            v = ((v + u) | (v - u)) & ones
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, bit-parallel over the rows.

    Common beginnings and ends are taken first; what is still long is cut where the two halves of ``b`` share most.
    """
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > CELLS and b1 - b0 > 1:
            middle = (b0 + b1) // 2
            before = _prefix_lengths(a[a0:a1], b[b0:middle])
            behind = _prefix_lengths(a[a0:a1][::-1], b[middle:b1][::-1])[::-1]
            cut = a0 + int((before + behind).argmax())
            work += [(a0, cut, b0, middle), (cut, a1, middle, b1)]
            continue
        rows, i, j = _rows(a[a0:a1], b[b0:b1]), a1 - a0, b1 - b0
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
                continue
            j -= 1
            if j and not rows[j - 1] >> (i - 1) & 1:
                continue
            i -= 1
            out.append(a0 + i)
    return sorted(out)


PARSED = (
    "block bigint, at int, id bigint, url string, host string, path string, digest binary, hashes array<bigint>, n_lines int, places array<int>, "
    "texts array<string>, marked boolean"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARSED`` from (part, id, url, host, path, html); ``at`` counts the rows of a block."""
    held = chunk = at = 0
    for batch in slices(batches, 500):
        out: list[list] = [[] for _ in range(8)]
        for part, html in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
            lines = lines_of(html or "")
            keep = ARTICLE if any(kind == ARTICLE for _, kind in lines) else OTHER
            hashes = np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line, _ in lines], np.uint64).view(np.int64)
            texts = [line.encode("utf-8", "replace").decode() for line, kind in lines if kind == keep]
            size = sum(map(len, texts)) + 64
            if held and held + size > BLOCK_BYTES:
                held, at, chunk = 0, 0, chunk + 1
            places = [i for i, (_, kind) in enumerate(lines) if kind == keep]
            row = (part << 32 | chunk, at, xxhash.xxh3_128_digest(hashes.tobytes()), hashes, len(lines), places, texts, keep == ARTICLE)
            for column, value in zip(out, row, strict=True):
                column.append(value)
            held, at = held + size, at + 1
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_()]
        made = [pa.array(values, kind) for values, kind in zip(out, kinds, strict=True)]
        names = [column.split()[0] for column in PARSED.split(", ")]
        yield pa.record_batch([*made[:2], *batch.columns[1:5], *made[2:]], names=names)


def _align(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Places of each page's lines that its neighbour has too; the neighbour is the one whose path is nearer."""
    shared = []
    for row in batch.select(["path", "hashes", "before", "after"]).to_pylist():
        others = [p for p in (row["before"], row["after"]) if p is not None]
        partner = max(others, key=lambda p: len(os.path.commonprefix([p["path"], row["path"]])), default=None)
        shared.append([] if partner is None else common_lines(row["hashes"], partner["hashes"]))
    return pa.record_batch([batch.column("host"), batch.column("digest"), pa.array(shared, pa.list_(pa.int32()))], names=["host", "digest", "shared"])


def _texts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block's pages: lines that the neighbour has go, then the structure's check puts an article's back."""
    shared = dict(zip(right["of_row"].to_pylist(), right["shared"].to_pylist(), strict=True))
    texts, n_shared = [], []
    for row in left.select(["at", "places", "texts", "marked"]).to_pylist():
        gone = set(shared.get(row["at"], ()))
        n_shared.append(len(gone))
        texts.append("\n".join(t for i, t in zip(row["places"], row["texts"], strict=True) if row["marked"] or i not in gone))
    return pa.table({"id": left["id"], "url": left["url"], "text": pa.array(texts, pa.string()), "n_lines": left["n_lines"].cast(pa.int64()), "n_shared": pa.array(n_shared, pa.int64())})


def shared_lines(parsed: DataFrame, parts: int | None = None) -> DataFrame:
    """(host, digest, shared) per line list of a host.

    ``parts`` is the number of parts of the sorted order, Spark's own choice if not given.
    """
    lists = parsed.where(F.size("hashes") > 0).groupBy("host", "digest").agg(F.min(F.struct("path", "hashes")).alias("page"))
    lists = lists.select("host", "page.path", "digest", "page.hashes")
    keys = ["host", "path", "digest"]
    ranged = lists.repartitionByRange(parts, *keys) if parts else lists.repartitionByRange(*keys)
    lists = stored(ranged.withColumn("part", F.spark_partition_id()), "line-lists")
    page, inside, edge = F.struct("host", "path", "hashes"), Window.partitionBy("part").orderBy(*keys), Window.orderBy("part", *keys)
    rows = lists.withColumn("before", F.lag(page).over(inside)).withColumn("after", F.lead(page).over(inside))
    at_edge = F.col("before").isNull() | F.col("after").isNull()
    # two rows of each part at most
    edges = rows.where(at_edge).withColumn("before", F.coalesce("before", F.lag(page).over(edge))).withColumn("after", F.coalesce("after", F.lead(page).over(edge)))
    own = [F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)).alias(side) for side in ("before", "after")]
    pairs = rows.where(~at_edge).unionByName(edges).select(*keys, "hashes", *own)
    return pairs.mapInArrow(by_batch(_align), "host string, digest binary, shared array<int>")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", parts: int | None = None) -> DataFrame:
    """(id, url, text, n_lines, n_shared) per row of ``pages``: its main text, its lines, and how many of them its neighbour has too."""
    spark, html = pages.sparkSession, F.col(html_column).cast("string")
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    rows = pages.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), html.alias("html"))
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, total // BUCKET_BYTES + 1))
    name = f"page_lines_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(_parse, PARSED).write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    parsed = spark.table(name)
    found = parsed.select("block", "at", "host", "digest").join(shared_lines(parsed, parts).where(F.size("shared") > 0), ["host", "digest"])
    found = found.select(F.col("block").alias("of_block"), F.col("at").alias("of_row"), "shared")
    blocks = parsed.select("block", "at", "id", "url", "n_lines", "places", "texts", "marked")
    return blocks.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_texts, "id bigint, url string, text string, n_lines bigint, n_shared bigint")
