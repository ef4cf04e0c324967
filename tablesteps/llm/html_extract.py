"""Main text of web pages with host suffix arrays.

1. Tasks cut each page into blocks of text and sort them by its markup:
   ``OUT`` (menus, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles, comments), ``MAIN`` (inside an article, or else the main
   element) and ``OPEN`` (all else).  Names of classes and ids, and forms, only
   hint: they put an element out if it holds no article or main element and,
   where no such element stands beside it, less than half of the words.
   Elements named for reader comments are out whatever their size.
2. The token stream of a page is its words outside ``MAIN``.  Different
   streams of one host are dealt to shards of about ``SHARD_BYTES`` of HTML
   (by a hash of the stream), so a host with a third of all pages is many
   shards.  In a shard the streams are concatenated and ordered by a suffix
   array, which gives the substrings of ``LONG`` words and how many different
   streams hold each; hashes of the substrings are counted over all shards of
   the host.  Those on ``MIN_PAGES`` different streams and on ``SHARE`` of all
   different streams of the host are boilerplate, however many shards it has.
3. The text of a page is its ``MAIN`` blocks and its ``OPEN`` blocks, in
   order.  An ``OPEN`` block goes if boilerplate covers all of it; else it
   loses covered runs of ``LONG_RUN`` words: what few pages share stays.
   ``MAIN`` blocks all stay, also where other pages have them.

Pages are dealt to shards of their host in the same way (by a hash of the
page), each with the boilerplate of the whole host.

Defined results: a null or empty page has the empty text.  A null or odd URL
belongs to the host of empty name.  Repeated rows get equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_text, quoted, saved
from .suffixes import suffix_array

#: HTML in a shard: bounds what one task gathers of a host, and decides nothing else.
SHARD_BYTES = 2 << 20
#: Words of the substrings that are counted, and of the shortest run cut out of a block that is not all boilerplate.
LONG = 6
LONG_RUN = 12
#: Boilerplate stands on so many different pages of its host, and on so large a share of them.
MIN_PAGES = 3
SHARE = 0.25

OUT, OPEN, MAIN = 0, 1, 2

# Elements by their part in a page.
_RAW = "script style noscript template iframe svg math canvas object textarea select xmp"
_OUT_TAGS = set("head title nav footer aside button dialog menu option datalist".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_OUT_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())
# Words of class and id names that mark what is no article.
_OUT_WORDS = set(
    "nav navbar navigation menu masthead header footer sidebar aside ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup share sharing social breadcrumb breadcrumbs related "
    "recommended comment comments reply replies respond disqus login search widget toolbar pagination pager "
    "copyright disclaimer".split()
)
_COMMENT_WORDS = set("comment comments reply replies respond disqus".split())
# Words at the end of a name that say nothing of what it names: ``share-bar`` names share, ``share-price`` doesn't.
_SHELL_WORDS = set(
    "area bar block body bottom box bundle button buttons card cards cell center column col container content desktop footer grid group "
    "header holder icon icons inner inline item items layout left link links list main mobile module nav outer panel placeholder post "
    "posts region right row section slot space strip tab tabs text title top unit view widget widgets wrap wrapper zone".split()
)
_SPARING = set("no has with without".split())
_OWN_HEADER = set("article post entry content story page".split())
KEEP, HINT, COMMENTS, HARD = 0, 1, 2, 3

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(_RAW.split()) + r")\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def named_for(name: str) -> int:
    """What a class or id name says: ``HINT`` that it is no part of an article, reader ``COMMENTS``, or nothing (``KEEP``)."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    words = [w for w in words if not w.isdigit()]
    if _SPARING & set(words):
        return KEEP
    while words:
        head = words.pop()
        if head in _COMMENT_WORDS:
            return COMMENTS
        if head in _OUT_WORDS and not (head == "header" and _OWN_HEADER & set(words)):
            return HINT
        if head not in _SHELL_WORDS:
            return KEEP
    return KEEP


def marked(tag: str, attributes: str) -> int:
    """Whether attributes say that an element is no part of an article: ``HARD`` (hidden, or by its role), ``HINT``,
    ``COMMENTS`` or ``KEEP``."""
    found = KEEP
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HARD
        if name == "role" and value.lower() in _OUT_ROLES:
            return HARD
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            found = max([found, *map(named_for, value.split())])
    return found


def main_kind(tag: str, attributes: str) -> int:
    """2 for an article, 1 for a main element, 0 for others."""
    if tag == "article":
        return 2
    low = attributes.lower()
    if "articlebody" in low or re.search(r"role\s*=\s*[\"']?article", low):
        return 2
    return int(tag == "main" or bool(re.search(r"role\s*=\s*[\"']?main", low)))


def blocks_of(page: str) -> list[tuple[int, str]]:
    """Blocks of a page in order: part and text (references decoded, white space made one space)."""
    found: list[tuple[bool, int, tuple[int, ...], str]] = []
    text: list[str] = []
    # Elements that hints mark: reader comments, inside a main element, holding one, words.
    hints: list[list] = []
    # Tag, out, best main element around, hinted elements around.
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = [("", False, 0, ())]

    def close() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append((*stack[-1][1:], line))
            text.clear()

    def pop_to(at: int) -> None:
        del stack[at:]

    place = 0
    for m in _PIECE.finditer(page):
        if m.start() > place:
            part = page[place : m.start()]
            text.append(html.unescape(part) if "&" in part else part)
        place = m.end()
        if m[3] is None:
            continue  # comments, scripts and their like leave no trace
        tag, attributes = m[3].lower(), m[4]
        inline = tag in _INLINE
        if not inline:
            if tag == "br":
                text.append(" ")
                continue
            close()
        if m[2]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if at:
                if inline and differ(stack[at], stack[-1]):
                    close()
                if inline and any(s[0] not in _INLINE for s in stack[at + 1 :]):
                    continue  # an inline end tag does not close blocks
                if inline and differ(stack[at], stack[at - 1]):
                    close()
                pop_to(at)
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        if not inline:  # paragraphs and items end where the next block begins
            for ends in ("p", "li", "option", "dt", "dd"):
                if tag == ends or ends == "p" or {tag, ends} == {"dt", "dd"}:
                    at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] not in _INLINE), 0)
                    if at and stack[at][0] == ends:
                        pop_to(at)
        _, out, kind, around = stack[-1]
        own = marked(tag, attributes) if attributes else KEEP
        of_main = main_kind(tag, attributes)
        if of_main == 2 and own == HINT:
            own = KEEP  # an article is no notice, whatever its classes
        if not out and (own == HARD or tag in _OUT_TAGS or tag == "header" and kind < 2):
            if inline:
                close()
            out = True
        elif not out and (own or tag == "form"):
            if inline:
                close()
            around = (*around, len(hints))
            hints.append([own == COMMENTS, kind > 0, False, 0])
        if of_main and not out:
            for i in around:
                hints[i][2] = True
        stack.append((tag, out, max(kind, of_main), around))
    if place < len(page):
        part = page[place:]
        text.append(html.unescape(part) if "&" in part else part)
    close()
    # Comments first: what they hold counts for nothing else.
    found = [(out or any(hints[i][0] for i in around), kind, around, line) for out, kind, around, line in found]
    total, in_main = 0, 0
    for out, kind, around, line in found:
        if not out:
            n = line.count(" ") + 1
            total, in_main = total + n, in_main + n * (kind > 0)
            for i in around:
                hints[i][3] += n
    gone = {
        i
        for i, (_, inside, holds, n) in enumerate(hints)
        if not holds and (2 * n < (in_main if inside else total) or not inside and in_main)
    }
    found = [(out or any(i in gone for i in around), kind, around, line) for out, kind, around, line in found]
    best = max((kind for out, kind, _, _ in found if not out), default=0)
    return [(OUT if out else MAIN if kind and kind == best else OPEN, line) for out, kind, _, line in found]


def differ(a: tuple, b: tuple) -> bool:
    """Whether text in two elements can be of different parts."""
    return a[1] != b[1] or a[3] != b[3]


def hash_of(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def number_of(word: str) -> int:
    """The number of a word, the same in every task (never 0)."""
    return hash_of(word.encode("utf-8", "replace")) or 1


def numbers_of(words: list[str]) -> np.ndarray:
    return np.array([number_of(w) for w in words], dtype=np.int64)


def needed(total: int, share: float, min_pages: int) -> int:
    """How many of ``total`` different pages make boilerplate."""
    return max(min_pages, math.ceil(share * total))


def window_hashes(numbers: np.ndarray, long: int) -> np.ndarray:
    """A hash of every ``long`` consecutive numbers."""
    n = max(len(numbers) - long + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(long):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[j : j + n].view(np.uint64)
    return out.view(np.int64)


def covered_by(hit: np.ndarray, size: int, long: int) -> np.ndarray:
    """Which of ``size`` tokens lie in the substrings of ``long`` tokens that begin at ``hit``."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + long, -1)
    return np.cumsum(edges)[:-1] > 0


def substrings(streams: list[np.ndarray], long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The substrings of ``long`` tokens in different streams of tokens (from 1): the places where they begin in
    the streams, each followed by a gap, ordered by a suffix array; the substring at each place; how many streams
    hold each substring; and where each stream starts (with the end as last)."""
    gap = np.zeros(1, dtype=np.int64)
    tokens = np.concatenate([x for s in streams for x in (s, gap)] + [np.zeros(long + 3, dtype=np.int64)])
    sizes = np.array([len(s) + 1 for s in streams], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    page = np.repeat(np.arange(len(streams)), sizes)
    room = np.repeat(starts[1:] - 1, sizes) - np.arange(len(page))  # tokens left in the page
    at = np.flatnonzero(room >= long)
    if not len(at):
        return at, at, at, starts
    order = suffix_array(tokens, at, long)
    equal = np.ones(len(order) - 1, dtype=bool)
    for j in range(long):
        equal &= tokens[order[1:] + j] == tokens[order[:-1] + j]
    group = np.concatenate([[0], np.cumsum(~equal)])
    seen = np.unique(group * np.int64(len(streams)) + page[order]) // len(streams)
    return order, group, np.bincount(seen, minlength=group[-1] + 1), starts


def repeated(streams: list[np.ndarray], long: int = LONG, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each stream of token numbers (from 1) which tokens lie in substrings of ``long`` or more
    tokens that stand in ``min_pages`` or more different streams."""
    different: dict[bytes, int] = {}
    owner = [different.setdefault(s.tobytes(), len(different)) for s in streams]
    firsts = {o: i for i, o in reversed(list(enumerate(owner)))}
    order, group, spread, starts = substrings([streams[firsts[o]] for o in range(len(different))], long)
    mask = covered_by(order[spread[group] >= min_pages], starts[-1], long)
    return [mask[starts[o] : starts[o + 1] - 1] for o in owner]


def lost_in(own: np.ndarray, run: int) -> np.ndarray:
    """What a block loses: all of it, or covered runs of ``run`` words or more.  (The words with which
    several pages happen to go on after the same notice stay.)"""
    if own.all():
        return own
    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
    out = own.copy()
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out[a:b] = b - a >= run
    return out


def stream_of(parts: list[int], blocks: list[str]) -> np.ndarray:
    return numbers_of([w for part, b in zip(parts, blocks) if part != MAIN for w in b.split()])


def evidence() -> Callable[[pa.Array], list[pa.Array]]:
    """The function from texts ``host/html`` to the stream of the page (numbers of the words) and its hash, null where
    the task has met it of the host."""
    met: set[tuple[str, int]] = set()

    def run(texts: pa.Array) -> list[pa.Array]:
        digests, streams = [], []
        for text in texts.to_pylist():
            host, _, page = text.partition("/")
            found = blocks_of(page)
            stream = stream_of([p for p, _ in found], [b for _, b in found])
            digest = hash_of(stream.tobytes())
            if len(met) >= 1 << 20:
                met.clear()  # bounded; the group of a shard drops copies anyway
            new = (host, digest) not in met
            met.add((host, digest))
            digests.append(digest if new else None)
            streams.append(stream if new else None)
        return [pa.array(digests, pa.int64()), pa.array(streams, pa.list_(pa.int64()))]

    return run


def count_group(long: int, min_pages: int, share: float) -> Callable[[pa.Table], pa.Table]:
    """The function over one shard of the streams of a host: substrings (as hashes) and how many streams hold each.
    A host of one shard is judged here; of others all rows count, and the one without a hash says how many streams
    there are."""

    def run(table: pa.Table) -> pa.Table:
        host, alone = table.column("host")[0].as_py(), table.column("shards")[0].as_py() == 1
        kept: dict[int, list[int]] = {}
        for digest, numbers in zip(*(table.column(c).to_pylist() for c in ("digest", "numbers"))):
            kept.setdefault(digest, numbers)
        streams = [np.array(x, dtype=np.int64) for x in kept.values()]
        order, group, n, starts = substrings(streams, long)
        hashes = np.zeros(starts[-1] + long, dtype=np.int64)
        for s, at in zip(streams, starts.tolist()):
            own = window_hashes(s, long)
            hashes[at : at + len(own)] = own
        found = hashes[order[np.flatnonzero(np.diff(group, prepend=-1))]]
        wanted = n >= (needed(len(streams), share, min_pages) if alone else 1)
        found, n = found[wanted].tolist(), n[wanted].tolist()
        if not alone:
            found, n = [*found, None], [*n, len(streams)]
        return pa.table([pa.array([host] * len(n), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["host", "hash", "n"])

    return run


def clean_group(names: list[str], long: int, long_run: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function over one shard of the pages of a host and the hashes of the host's boilerplate."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        hashes = np.unique(np.array([h for row in known.column("hashes").to_pylist() for h in row], dtype=np.int64))
        texts, counts = [], []
        for parts, blocks in zip(table.column("parts").to_pylist(), table.column("blocks").to_pylist()):
            stream = stream_of(parts, blocks)
            own = window_hashes(stream, long)
            hit = np.zeros(len(own), dtype=bool)
            if len(hashes):  # sorted once for the shard
                hit = hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own
            mask = covered_by(np.flatnonzero(hit), len(stream), long)
            kept, at = [], 0
            for part, block in zip(parts, blocks):
                if part == MAIN:
                    kept.append(block)
                    continue
                words = block.split()
                own, at = mask[at : at + len(words)], at + len(words)
                if part == OPEN:
                    left = [w for w, cut in zip(words, lost_in(own, long_run).tolist()) if not cut]
                    if left:
                        kept.append(" ".join(left))
            texts.append(" ".join(kept))
            counts.append(int(mask.sum()))
        return pa.table(
            [*[table.column(n) for n in names], pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
            names=[*names, "text", "n_repeated"],
        )

    return run


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def boilerplate(source: DataFrame, dealt: Callable[[DataFrame, str], DataFrame], long: int, min_pages: int, share: float) -> DataFrame:
    """``host``, ``hashes``: substrings of ``long`` words that stand on enough different streams of the whole host."""
    paths = source.select("host", F.concat("host", F.lit("/"), F.coalesce("html", F.lit(""))).alias("path"))
    fields = [StructField("digest", LongType()), StructField("numbers", ArrayType(LongType()))]
    found = map_text(paths, "path", ["host"], fields, evidence).filter("digest IS NOT NULL")
    items = dealt(found, "digest")
    schema = StructType([StructField("host", StringType()), StructField("hash", LongType()), StructField("n", LongType())])
    groups = items.select("host", "shard", "shards", "digest", "numbers").repartition("host", "shard").groupBy("host", "shard")
    counts = saved(source.sparkSession, groups.applyInArrow(count_group(long, min_pages, share), schema), "html-counts")
    # One row for each host of more than one shard.
    totals = counts.filter("hash IS NULL").groupBy("host").agg(F.sum("n").alias("total"))
    sums = counts.filter("hash IS NOT NULL").groupBy("host", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages)
    often = sums.join(F.broadcast(totals), "host", "left").filter(F.col("n") >= F.ceil(share * F.coalesce("total", F.lit(0))))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(
    pages: DataFrame,
    keep: list[str],
    url_col: str = "url",
    html_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    long: int = LONG,
    min_pages: int = MIN_PAGES,
    long_run: int = LONG_RUN,
    share: float = SHARE,
) -> DataFrame:
    """``keep`` columns, ``text`` (the main text) and ``n_repeated`` (words outside the article that boilerplate covers)."""
    names = [f"k{i}" for i in range(len(keep))]
    source = pages.select(
        F.col(quoted(html_col)).cast("string").alias("html"),
        host_of(F.col(quoted(url_col)).cast("string")).alias("host"),
        *[F.col(quoted(c)).alias(n) for c, n in zip(keep, names)],
    ).withColumn("deal", F.xxhash64(F.coalesce("html", F.lit("")), *names))

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            rows = [blocks_of(t or "") for t in texts.to_pylist()]
            return [
                pa.array([[p for p, _ in r] for r in rows], pa.list_(pa.int32())),
                pa.array([[b for _, b in r] for r in rows], pa.list_(pa.string())),
            ]

        return run

    fields = [StructField("parts", ArrayType(IntegerType())), StructField("blocks", ArrayType(StringType()))]
    cut = map_text(source, "html", ["host", "deal", *names], fields, make)
    # Hosts of more than one shard: few rows (all HTML over SHARD_BYTES at most).  Written first, so that
    # Spark knows their size and need not shuffle the pages to look them up.
    shards = F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / shard_bytes).cast("int")
    large = saved(pages.sparkSession, source.groupBy("host").agg(shards.alias("shards")).filter("shards > 1"), "html-hosts")
    n_shards = F.coalesce("shards", F.lit(1)).cast("int")

    def dealt(rows: DataFrame, deal: str) -> DataFrame:
        return rows.join(large, "host", "left").withColumn("shards", n_shards).withColumn("shard", F.pmod(deal, "shards").cast("int"))

    known = saved(pages.sparkSession, boilerplate(source, dealt, long, min_pages, share), "html-boilerplate")
    copies = known.join(large, "host", "left").select("host", F.explode(F.sequence(F.lit(0), n_shards - 1)).alias("shard"), "hashes")
    kept = [f for f in cut.schema.fields if f.name in names]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_repeated", LongType())])
    columns = ["host", "shard", *names, "parts", "blocks"]
    left = dealt(cut, "deal").select(*columns).repartition("host", "shard").groupBy("host", "shard")
    out = left.cogroup(copies.groupBy("host", "shard")).applyInArrow(clean_group(names, long, long_run), schema)
    return out.toDF(*keep, "text", "n_repeated")
