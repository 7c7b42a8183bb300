"""Main text of web pages (operator 6): a suffix array for each host, with markup roles for what repetition can't tell.

A page is cut into blocks. The host's pages are laid one after another as a token stream; a suffix array (prefix
doubling up to RUN tokens) finds the substrings of RUN or more tokens, or whole shorter blocks, that stand on at least
PAGES distinct pages, and a block that such substrings cover to COVERED of its length is boilerplate. Sorting to a depth
of RUN is enough: a place lies in a repeat of RUN tokens or more exactly if it lies in a repeat of RUN tokens.

The array goes first and decides menus, footers, notices and other blocks outside articles on every page. Markup decides
what repetition can't:

* blocks in parts that markup names as menu, header, footer, sidebar, notice, advert, form or comments are no text even
  if they stand on one page only, as adverts and comments do;
* on a page with text in an article or main part, unique blocks outside it are no text; on any other page they are;
* inside an article, repetition on PAGES pages proves nothing, since articles are copied and share passages. A block
  inside articles is boilerplate only if it stands, as a whole, in EVERYWHERE of the host's distinct articles, of which
  there must be ARTICLES at least.

Streams of large hosts are dealt into shards of at most about SHARD tokens by page, so no task gets an unbounded group.
What repeats is still decided over the whole host: each shard gives the hashes of its windows with their pages (PAGES
of them at most, which settles the test), Spark counts distinct pages of a host and hash, and the hashes on PAGES
pages or more go back to the shards that hold them. A host's result doesn't depend on how its pages are dealt.

Defined results: null or empty html gives ''; pages with equal blocks count as one page in the arrays, and so do equal
articles; repeated rows, and rows that share a page_id or have none, are pages of their own.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import salted_rows_bound, table, written

RUN, PAGES, COVERED, SHARD = 8, 3, 0.8, 250_000
EVERYWHERE, ARTICLES = 0.5, 8
BROADCAST_ROWS = 200_000  # hosts, or template blocks of all hosts; beyond it the join shuffles
TEXT, OPEN, NOT_TEXT = 0, 1, 2

#: Element and class names that say what a part of a page is.
DROPPED = frozenset("head nav footer aside form button select menu dialog datalist fieldset noscript".split())
RAW = frozenset("script style template textarea title iframe svg math object canvas audio video xmp noembed noframes".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay comment comments discussion disqus replies respond social share sharing related recommended widget login search pagination pager toolbar masthead".split())
LAYOUT_NAMES = frozenset("area bar block body bottom box button buttons card cards col column container content contents foot group head header heading holder icon icons inner item items left line link links list lists main module nav outer panel part post posts article articles right row section site slot story stories text thread title top unit wrap wrapper zone".split())
MAIN_NAMES = frozenset("article-body articlebody article-content post-content entry-content main-content story-body".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_attr = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_close = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_word = re.compile(r"[^\s_-]+")


def _named(name: str, inside: bool) -> bool:
    """Does a class or id name a dropped part? Inside an article all its words must be names of parts or of layout
    ("related-posts"), since a section may be named after its subject ("related-work")."""
    words = _word.findall(name)
    return not BAD_NAMES.isdisjoint(words) and (not inside or all(w in BAD_NAMES or w in LAYOUT_NAMES or w.isdigit() for w in words))


def _role(tag: str, attrs: str, inside: bool) -> int | None:
    """TEXT for a main part, NOT_TEXT for a dropped one, None where this element says nothing."""
    if tag in DROPPED or tag == "header" and not inside:
        return NOT_TEXT
    main = tag in MAIN
    if attrs and not attrs.isspace():
        a = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _attr.finditer(attrs)}
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) or a.get("role") in BAD_ROLES:
            return NOT_TEXT
        names = f"{a.get('class', '')} {a.get('id', '')}"
        if not main and tag not in ("html", "body") and any(_named(name, inside) for name in names.split()):
            return NOT_TEXT
        main = main or a.get("role") == "main" or a.get("itemprop") == "articlebody" or not MAIN_NAMES.isdisjoint(names.split())
    return TEXT if main else None


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, role) of a page's blocks in order: TEXT in an article or main part, NOT_TEXT in a part with such a name,
    else OPEN. A page without a main part has none of role TEXT."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    part: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]  # open elements that set or bound roles
    at, end = 0, len(page)

    def flush() -> None:
        if part:
            text = " ".join(html_lib.unescape("".join(part)).split())
            if text:
                out.append((text, stack[-1][1]))
            part.clear()

    while at < end:
        m = _tag.search(page, at)
        if not m:
            part.append(page[at:])
            break
        if m.start() > at:
            part.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            elif tag in ("br", "td", "th"):
                part.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCK:
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            c = _close[tag].search(page, at)
            at = c.end() if c else end
            continue
        if tag == "br":
            part.append(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        here = stack[-1][1]
        role = _role(tag, m[3], here == TEXT)
        if role is not None or tag in BLOCK and tag not in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            if role is not None and tag not in BLOCK:
                flush()
            stack.append((tag, NOT_TEXT if here == NOT_TEXT else here if role is None else role))
    flush()
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("text", pa.string()), ("role", pa.int8())]))
    for batch in batches:
        urls = batch.column("url").to_pylist()
        hosts = []
        for u in urls:
            try:
                hosts.append((urlsplit(u or "").hostname or "") if u else "")
            except ValueError:
                hosts.append("")
        got = [[{"text": t, "role": r} for t, r in blocks_of(h.as_py())] for h in batch.column("html")]
        columns = [batch.column("uid"), batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(got, block)]
        yield pa.RecordBatch.from_arrays(columns, ["uid", "page_id", "url", "host", "blocks"])


def parsed(pages: DataFrame) -> DataFrame:
    """uid, page_id, url, host, blocks (text, role); uid is a digest of the row, so equal rows are one page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select(F.xxhash64("page_id", "url", "html").alias("uid"), "page_id", "url", "html")
    return rows.mapInArrow(_parsed, "uid long, page_id long, url string, host string, blocks array<struct<text:string,role:tinyint>>")


def _cover(hit: np.ndarray, n: int, run: int) -> np.ndarray:
    """The places that substrings of ``run`` tokens from the starts ``hit`` cover."""
    mark = np.zeros(n + run, np.int64)
    mark[hit] += 1
    mark[hit + run] -= 1
    return np.cumsum(mark)[:n] > 0


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES, starts: np.ndarray | None = None) -> np.ndarray:
    """For each place of a token stream: does a substring of ``run`` tokens that stands on ``pages`` distinct pages cover it?

    ``starts``: the only places where substrings begin."""
    n, width = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    while width < run:
        step = min(width, run - width)
        ahead = np.full(n, -1)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1]
        width += step
    order = np.lexsort((page, rank))  # the suffixes, sorted by their first ``run`` tokens
    starts = np.ones(n, bool) if starts is None else starts
    order = order[starts[order]]
    r, p = rank[order], page[order]
    new = np.r_[np.ones(min(len(r), 1), bool), (r[1:] != r[:-1]) | (p[1:] != p[:-1])]
    often = np.bincount(r, new, minlength=int(rank.max()) + 1 if n else 0) >= pages
    return _cover(np.flatnonzero(often[rank] & starts), n, run)


def _stream(df: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order, their token stream, their sizes in it, the page key of each block, and where substrings begin:
    at every RUN tokens within a block, and at a shorter block as a whole."""
    df = df.sort_values(["uid", "block"], kind="stable")
    ends = np.full(RUN, 1, np.uint64).tobytes()  # the same end for every block, so that short blocks are substrings of RUN tokens
    stream = np.frombuffer(b"".join(t + ends for t in df["tokens"]), np.uint64)
    sizes = df["tokens"].map(len).to_numpy() // 8 + RUN
    keys = df["content"].to_numpy(np.int64)  # pages of equal blocks count once
    at = np.arange(len(stream)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    starts = at <= np.repeat(np.maximum(sizes - 2 * RUN, 0), sizes)
    return df, stream, sizes, keys, starts


def _boilerplate(df: pd.DataFrame, sizes: np.ndarray, covered: np.ndarray) -> pd.DataFrame:
    """The blocks that ``covered`` places of the stream cover to COVERED of their length."""
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    share = [covered[a : a + k - RUN].mean() if k > RUN else 0.0 for a, k in zip(first, sizes, strict=True)]
    return df[np.array(share) >= COVERED][["uid", "block"]].astype("int64")


def _whole(df: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a host that is one shard -> its blocks that are boilerplate."""
    df, stream, sizes, keys, starts = _stream(df)
    return _boilerplate(df, sizes, repeated(stream, np.repeat(keys, sizes), starts=starts))


def _hashes(stream: np.ndarray) -> np.ndarray:
    """A hash of the RUN tokens from each place on."""
    n, h = len(stream), np.zeros(len(stream), np.uint64)
    ahead = np.r_[stream, np.zeros(RUN, np.uint64)]
    for k in range(RUN):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ahead[k : k + n]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _windows(df: pd.DataFrame) -> pd.DataFrame:
    """One host shard's blocks -> host, shard, hash of a substring, key of a page that holds it; at most PAGES pages of a hash."""
    host, shard = df["host"].iloc[0], df["shard"].iloc[0]
    _, stream, sizes, keys, starts = _stream(df)
    got = pd.DataFrame({"hash": _hashes(stream)[starts], "key": np.repeat(keys, sizes)[starts]}).drop_duplicates()
    got = got[got.groupby("hash").cumcount() < PAGES]
    return got.assign(host=host, shard=shard)[["host", "shard", "hash", "key"]]


def _marked(df: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
    """One host shard's blocks, the hashes that stand on PAGES pages of the host -> its blocks that are boilerplate."""
    if df.empty:
        return pd.DataFrame({"uid": [], "block": []}, dtype="int64")
    df, stream, sizes, _, starts = _stream(df)
    hit = np.flatnonzero(starts & np.isin(_hashes(stream), often["hash"].to_numpy(np.int64)))
    return _boilerplate(df, sizes, _cover(hit, len(stream), RUN))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: the hash of its page's blocks, and those of its words, or inside an article one of the block
    and one of the article."""
    names, kinds = ["uid", "host", "block", "content", "article", "tokens"], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def hashed(words: list[str]) -> np.ndarray:
        return pd.util.hash_array(np.array(words, dtype=object), categorize=False)

    for batch in batches:
        rows = []
        for uid, host, blocks in zip(*(batch.column(c).to_pylist() for c in ("uid", "host", "blocks")), strict=True):
            own = [b["text"] for b in blocks if b["role"] == TEXT]
            content, article = hashed(["\n".join(b["text"] for b in blocks), "\n".join(own)]).view(np.int64).tolist()
            alone = iter(hashed(own)) if own else iter(())
            for k, b in enumerate(blocks):
                if b["role"] == TEXT:
                    rows.append((uid, host, k, content, article, next(alone).tobytes()))
                else:
                    rows.append((uid, host, k, content, None, (hashed(b["text"].split()) | np.uint64(2)).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def block_tokens(pages: DataFrame) -> DataFrame:
    """uid, host, block, content, article (null outside articles), tokens of all blocks of parsed pages."""
    return pages.select("uid", "host", "blocks").mapInArrow(_hashed, "uid long, host string, block long, content long, article long, tokens binary")


def repeated_blocks(tokens: DataFrame) -> DataFrame:
    """uid, block of the blocks outside articles that repeat across their host's pages, by the arrays."""
    rows = tokens.where("article is null").drop("article")
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.length("tokens") / 8 + RUN) / SHARD).cast("int").alias("shards"))
    few = F.broadcast(sizes) if salted_rows_bound(sizes, BROADCAST_ROWS) else sizes
    dealt = rows.join(few, "host").withColumn("shard", F.pmod(F.xxhash64("uid"), "shards")).repartition("host", "shard")  # not by host alone
    out = "uid long, block long"
    one, more = dealt.where("shards = 1"), dealt.where("shards > 1")
    windows = more.groupBy("host", "shard").applyInPandas(lambda df: _windows(df), "host string, shard long, hash long, key long")
    found = windows.groupBy("host", "hash").agg(F.collect_set("key").alias("keys"), F.collect_set("shard").alias("shards")).where(F.size("keys") >= PAGES)
    often = found.select("host", F.explode("shards").alias("shard"), "hash")
    marked = more.groupBy("host", "shard").cogroup(often.groupBy("host", "shard")).applyInPandas(lambda a, b: _marked(a, b), out)
    return one.groupBy("host", "shard").applyInPandas(lambda df: _whole(df), out).unionByName(marked)


def template_blocks(tokens: DataFrame) -> DataFrame:
    """uid, block of the blocks inside articles that stand in EVERYWHERE of their host's distinct articles."""
    rows = tokens.where("article is not null")
    total = rows.groupBy("host").agg(F.count_distinct("article").alias("articles")).where(F.col("articles") >= ARTICLES)
    spread = rows.groupBy("host", "tokens").agg(F.count_distinct("article").alias("n")).where(F.col("n") >= EVERYWHERE * ARTICLES)
    template = written(spread.join(total, "host").where(F.col("n") >= EVERYWHERE * F.col("articles")).select("host", "tokens"), "template")
    few = F.broadcast(template) if salted_rows_bound(template, BROADCAST_ROWS) else template
    return rows.join(few, ["host", "tokens"], "left_semi").select("uid", "block")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html), with the numbers of blocks that were left out
    because they repeat (repeated: outside articles, template: inside) and by markup alone (by_markup)."""
    rows = parsed(pages)
    tokens = written(block_tokens(rows), "tokens")
    gone = repeated_blocks(tokens).unionByName(template_blocks(tokens)).groupBy("uid").agg(F.collect_set("block").alias("drop"))
    rows = rows.join(gone, "uid", "left").withColumn("main", F.exists("blocks", lambda b: b["role"] == TEXT))
    drop = F.coalesce("drop", F.array().cast("array<bigint>"))
    marks = F.transform("blocks", lambda b, k: F.struct(b["text"].alias("text"), b["role"].alias("role"), F.array_contains(drop, k.cast("long")).alias("gone")))

    def is_text(b):
        return ~b["gone"] & ((b["role"] == TEXT) | (b["role"] == OPEN) & ~F.col("main"))

    def number(test):
        return F.size(F.filter("marks", test)).alias

    text = F.array_join(F.transform(F.filter("marks", is_text), lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", "main", marks.alias("marks")).select(
        "page_id", "url", text.alias("text"),
        number(lambda b: b["gone"] & (b["role"] != TEXT))("repeated"), number(lambda b: b["gone"] & (b["role"] == TEXT))("template"),
        number(lambda b: ~b["gone"] & ~is_text(b))("by_markup"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = main_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "repeated", "template", "by_markup")


QUERIES = {"op6_html_text": query}
ORACLES: dict[str, str] = {}
