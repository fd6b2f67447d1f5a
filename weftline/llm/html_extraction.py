"""Operator 10, main text of web pages with a suffix array for each host.

1. A page becomes blocks: text between block-level tags, character references decoded, white space
   folded.  Markup decides some blocks at once: script, style, menus, headers, footers, side bars, forms,
   notices, adverts and comments go; an article (or main) element vouches for what stands in it.
2. Pages go to their host.  It concatenates the token streams of the blocks that nothing has decided, sorts
   the suffixes, and finds token runs of at least ``min_run`` tokens that ``min_pages`` or more distinct
   pages hold.  A host of more than ``shard_pages`` pages is cut into shards by its pages' text; they count
   the pages of each run by its 64-bit hash, the counts are added up over the host, and the shards get back
   which runs are repeated.
3. Undecided blocks lose the tokens that such runs cover; what is left of them stays.  Pages of equal text
   count as one: copies are no boilerplate.  Article text stays whole even where it is repeated, for the
   same reason.
4. Where article elements hold at least half of a page's remaining words they are the page's main text; a
   page whose articles are teasers, or that has none, keeps its undecided blocks too.

A header inside an article loses all but its headings, which are the article's titles.  Class words do not
rule out article, main, html and body elements, nor elements that are also named as content.

Defined cases: null or empty html gives empty text; a null url is a host of its own; repeated rows stay
repeated; unquoted attribute values may hold quotes; unclosed and stray tags close with their parents or are passed over; an empty table gives an
empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, hashing
from weftline.llm.suffix_array import equal_runs, sort_suffixes

MIN_RUN, MIN_PAGES, SHARD_PAGES = 8, 3, 512
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_OUT_SQL = "page_id long, url string, text string, n_chars long"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"])
_SKIP = frozenset(
    "head script style title noscript template iframe object svg math canvas video audio nav header footer aside form button select textarea datalist dialog menu".split()
)
_MAIN = frozenset(["article", "main"])
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open p ends where one of these starts.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table div section article main aside nav header footer form body td th blockquote".split())
#: Words in class, id or role that mark boilerplate; whole words between separators.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|complementary|contentinfo|consent|cookie|cookies|disqus|"
    r"disclaimer|footer|gdpr|header|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|overlay|pager|pagination|popup|privacy|promo|promoted|promotion|reader-comments|"
    r"recommended|related|replies|respond|search|share|sharing|sidebar|sidenav|skip|social|sponsor|sponsored|subscribe|subscription|tags|toolbar|topbar|widget|widgets)(?:$|[\s_-])",
    re.I,
)
#: Names that mark an element as content, whatever else it is called.
_CONTENT = re.compile(r"(?:^|\s)(?:article|content|entry|entry-content|main|post|post-body|post-content|story)(?:$|\s)", re.I)
#: The element whose headings stay where it stands in an article.
_TITLED, _HEADINGS = "header", frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def _hidden(attributes: str) -> bool:
    return any(m[1].lower() == "hidden" or (m[1].lower() == "aria-hidden" and (m[2] or "").strip("\"'").lower() == "true") for m in _ATTR.finditer(attributes))


def _marked(attributes: str) -> bool:
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name in ("class", "id", "role") and _MARKS.search(value) and not _CONTENT.search(value):
            return True
    return False


def blocks_of_page(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article or main element) of the blocks that markup does not rule out."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, ruled out, main, out but for headings: with all their parents
    at, n = 0, len(page)
    out_now = main_now = False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, main_now))

    def settle() -> None:
        nonlocal out_now, main_now
        out_now, main_now = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while at < n:
        m = _TAG.search(page, at)
        start = m.start() if m else n
        if start > at and not out_now:
            parts.append(page[at:start])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        inline = name in _INLINE
        if not inline or not m[1]:
            if not inline:
                flush()
            elif name == "br" and not out_now:
                parts.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not inline or stack[k][1] != out_now:
                        flush()
                    del stack[k:]
                    settle()
                    break
                if inline and stack[k][0] not in _INLINE:
                    break  # a stray inline end does not close blocks
            continue
        if name in _ENDS_P or name in _ENDS_SELF:
            closing = ("p",) if name in _ENDS_P else _ENDS_SELF[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closing:
                    del stack[k:]
                    settle()
                    break
                if stack[k][0] in _SCOPE:
                    break
        titled = name == _TITLED and main_now and not out_now
        if name in _MAIN or name in ("html", "body"):
            gone = name not in ("html", "body") and _hidden(m[3])
        else:
            gone = name in _SKIP or (bool(m[3]) and _marked(m[3]))
        back = name in _HEADINGS and bool(stack) and stack[-1][3] and not (m[3] and _marked(m[3]))
        if name in _VOID or m[3].endswith("/") and name not in _RAW and not inline and name in ("svg", "math"):
            continue
        if name in _RAW:  # its content is no markup
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if gone and not out_now:
            flush() if not inline else None
        within = bool(stack) and stack[-1][3] and not gone and not back
        stack.append((name, (out_now or gone) and not back, main_now or (name in _MAIN and not (out_now or gone)), titled or within))
        settle()
    if not out_now:
        flush()
    return out


def parse(page: str | None) -> tuple[list[str], list[bool]]:
    """Blocks that markup does not rule out, and whether an article element vouches for each."""
    found = blocks_of_page(page or "")
    return [t for t, _ in found], [main for _, main in found]


def repeated_tokens(streams: list[np.ndarray], min_run: int, min_pages: int) -> list[np.ndarray]:
    """True at the tokens of each page that a run of min_run tokens on min_pages pages covers."""
    lengths = np.array([len(s) for s in streams], np.int64)
    tokens = np.concatenate(streams) if streams else np.empty(0, np.uint32)
    _, ids = np.unique(tokens, return_inverse=True)
    page = np.repeat(np.arange(len(streams)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.flatnonzero(np.arange(len(ids)) + min_run <= ends)
    text = np.ascontiguousarray(ids.astype(">u4")).view(np.uint8)  # big-endian ids sort as their bytes do
    order = starts[sort_suffixes(text, starts * 4, min_run * 4)]
    run = equal_runs(text, order * 4, min_run * 4)
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(run):
        pair = np.lexsort((page[order], run))
        r, p = run[pair], page[order][pair]
        new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])]
        pages = np.bincount(r[new], minlength=int(r[-1]) + 1)
        hit = order[pages[run] >= min_pages]
        covered += np.bincount(hit, minlength=len(ids) + 1)
        covered -= np.bincount(hit + min_run, minlength=len(ids) + 1)[: len(ids) + 1]
    flags = np.cumsum(covered[:-1]) > 0
    return np.split(flags, np.cumsum(lengths)[:-1]) if streams else []


def undecided_streams(pages: list[tuple[list[str], list[bool]]]) -> tuple[list[np.ndarray], list[int]]:
    """Token streams of what no article element vouches for, once for all pages of equal text, and which of them
    each page has."""
    place: dict[bytes, int] = {}
    streams, which = [], []
    for blocks, vouched in pages:
        if all(vouched):
            which.append(-1)
            continue
        text = hashlib.blake2b("\n".join(blocks).encode("utf-8", "replace"), digest_size=16).digest()
        k = place.setdefault(text, len(streams))
        if k == len(streams):
            streams.append(np.array([zlib.crc32(w.encode("utf-8", "replace")) for b, main in zip(blocks, vouched, strict=True) if not main for w in b.split()], np.uint32))
        which.append(k)
    return streams, which


def _run_hashes(stream: np.ndarray, min_run: int, host: int) -> np.ndarray:
    """A hash of the run that starts at each token."""
    _, runs = hashing.windows(hashing.mix64(stream.astype(np.uint64) + np.uint64(1)), np.array([0, len(stream)]), min_run)
    return hashing.mix64(runs ^ np.uint64(host))


def shard_runs(streams: list[np.ndarray], min_run: int, host: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a shard's runs, ascending, and on how many of the streams each stands."""
    own = [np.unique(_run_hashes(s, min_run, host)) for s in streams]
    return np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_counts=True)


def told_tokens(streams: list[np.ndarray], min_run: int, host: int, repeated: np.ndarray) -> list[np.ndarray]:
    """As ``repeated_tokens``, where the ascending hashes of the repeated runs are known."""
    out = []
    for s in streams:
        runs = _run_hashes(s, min_run, host)
        at = np.minimum(np.searchsorted(repeated, runs), max(len(repeated) - 1, 0))
        hit = np.flatnonzero(repeated[at] == runs) if len(repeated) else np.empty(0, np.int64)
        out.append(hashing.cover(hit, min_run, len(s)))
    return out


def extract_shard(pages: list[tuple[list[str], list[bool]]], min_run: int, min_pages: int, host: int = 0, repeated: np.ndarray | None = None) -> list[str]:
    """Main text of each page of a host, or of a shard that is told the host's repeated runs."""
    streams, which = undecided_streams(pages)
    found = repeated_tokens(streams, min_run, min_pages) if repeated is None else told_tokens(streams, min_run, host, repeated)
    out = []
    for (blocks, vouched), k in zip(pages, which, strict=True):
        kept, at = [], 0
        for block, main in zip(blocks, vouched, strict=True):
            if main:
                kept.append((block, True))
                continue
            tokens = block.split()
            gone = found[k][at : at + len(tokens)]
            at += len(tokens)
            if not gone.any():
                kept.append((block, False))
            elif not gone.all():
                kept.append((" ".join(w for w, g in zip(tokens, gone.tolist(), strict=True) if not g), False))
        sizes = [len(b.split()) for b, _ in kept] if k >= 0 else []
        inside = sum(n for n, (_, main) in zip(sizes, kept, strict=True) if main) if sizes else 0
        if inside and 2 * inside >= sum(sizes):
            kept = [b for b in kept if b[1]]
        out.append("\n".join(b for b, _ in kept))
    return out


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_run: int = MIN_RUN,
    min_pages: int = MIN_PAGES,
    shard_pages: int = SHARD_PAGES,
    host_limit: int = 100_000,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Hosts above ``shard_pages`` pages are listed with their number of shards; the list is broadcast up
    to ``host_limit`` hosts, checked, and joined by shuffle beyond."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    # counted on the hosts alone; the pages' html is not read for it
    large = own.select(host.alias("host")).groupBy("host").count().where(F.col("count") > shard_pages)
    large = large.select("host", F.ceil(F.col("count") / shard_pages).cast("long").alias("shards"))
    side = F.broadcast(large) if large.limit(host_limit + 1).count() <= host_limit else large
    placed = own.withColumn("host", host).join(side, "host", "left")
    placed = placed.select("page_id", "url", "html", F.xxhash64("host").alias("host"), F.coalesce("shards", F.lit(1).cast("long")).alias("shards"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, shards = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            # (shard, host, whether the host has several): page text -> pages of that text
            groups: dict[tuple[int, int, bool], dict[str, list[list[Any]]]] = {}
            urls = batch.column(1).cast(pa.large_binary())
            for k, raw in enumerate(batch.column(2).cast(pa.large_binary())):
                blocks, main = parse((raw.as_py() or b"").decode("utf-8", "replace"))
                url = urls[k].as_py()
                shard = hosts[k]
                if shards[k] > 1:  # pages of equal text meet in one shard
                    tokens = hashlib.blake2b("\n".join(blocks).encode("utf-8", "replace"), digest_size=8).digest()
                    spot = np.array([hosts[k]]).view(np.uint64) ^ hashing.mix64(np.array([int.from_bytes(tokens, "big") % shards[k] + 1], np.uint64))
                    shard = int(spot.view(np.int64)[0])
                same = groups.setdefault((shard, hosts[k], shards[k] > 1), {})
                text = json.dumps([blocks, main])
                same.setdefault(text, []).append([batch.column(0)[k].as_py(), None if url is None else url.decode("utf-8", "replace")])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in groups], pa.int64()),
                    pa.array([g[1] for g in groups], pa.int64()),
                    pa.array([g[2] for g in groups], pa.bool_()),
                    pa.array([common.zip_bytes(json.dumps(list(g.items())).encode()) for g in groups.values()], pa.binary()),
                ],
                names=["shard", "host", "several", "payload"],
            )

    def hosts_of(group: pa.Table) -> Iterator[tuple[int, bool, list[list[Any]], list[tuple[list[str], list[bool]]]]]:
        """Pages by host (a host has a key of its own but for chance)."""
        found: dict[tuple[int, bool], list[Any]] = {}
        for host, several, payload in zip(group["host"].to_pylist(), group["several"].to_pylist(), group["payload"].to_pylist(), strict=True):
            found.setdefault((host, several), []).extend(json.loads(common.unzip_bytes(payload)))
        for (host, several), items in found.items():
            yield host & (1 << 64) - 1, several, [rows for _, rows in items], [tuple(json.loads(text)) for text, _ in items]

    def texts_of(group: pa.Table, told: pa.Table | None) -> pa.Table:
        ids, urls, texts = [], [], []
        for host, several, rows, parsed in hosts_of(group):
            repeated = np.unique(np.concatenate([np.empty(0, np.uint64), *(common.unpack_arrays(p)[0] for p in told["runs"].to_pylist())])) if several and told is not None else None
            for same, text in zip(rows, extract_shard(parsed, min_run, min_pages, host, repeated), strict=True):
                ids += [r[0] for r in same]
                urls += [r[1] for r in same]
                texts += [text] * len(same)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    def extract(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        return texts_of(group, None)

    def extract_told(key: tuple[Any, ...], group: pa.Table, told: pa.Table) -> pa.Table:
        return texts_of(group, told)

    packed = placed.mapInArrow(pack, "shard long, host long, several boolean, payload binary")
    if not large.limit(1).count():
        return packed.groupBy("shard").applyInArrow(extract, _OUT_SQL)
    n = common.shuffle_partitions(spark)
    grouped = packed.repartition(n, "shard").groupBy("shard")
    runs_out = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("runs", pa.binary())])

    def runs(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        for host, several, _, parsed in hosts_of(group):
            if several:
                streams, _ = undecided_streams(parsed)
                found, pages_of = shard_runs(streams, min_run, host)
                to = common.bucket_of(found, 2 * n)  # ascending, as the hashes are
                out += [(int(to[a]), key[0].as_py(), common.pack_arrays(found[a:b], pages_of[a:b].astype(np.int32))) for a, b in common.segments(to)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], runs_out.field(i).type) for i in range(3)], schema=runs_out)

    def add_up(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        parts = [common.unpack_arrays(p) for p in group["runs"].to_pylist()]
        every, spot = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        repeated = np.bincount(spot, weights=np.concatenate([p[1] for p in parts]), minlength=len(every)) >= min_pages
        out, at = [], 0
        for shard, (own, _) in zip(group["shard"].to_pylist(), parts, strict=True):
            hit = repeated[spot[at : at + len(own)]]
            at += len(own)
            if hit.any():
                out.append((key[0].as_py(), shard, common.pack_arrays(own[hit])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], runs_out.field(i).type) for i in range(3)], schema=runs_out)

    kind = "bucket long, shard long, runs binary"
    told = grouped.applyInArrow(runs, kind).groupBy("bucket").applyInArrow(add_up, kind).select("shard", "runs")
    return grouped.cogroup(told.groupBy("shard")).applyInArrow(extract_told, _OUT_SQL)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
