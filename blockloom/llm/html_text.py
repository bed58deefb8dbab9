"""Main text of HTML pages: structure of the page, and a suffix array over the pages of its host.

Pages of a host are dealt into shards of about ``SHARD_PAGES`` pages and ``SHARD_BYTES`` (a large host has many, so no group
grows with it). A shard concatenates the token streams of its pages, all blocks that are no part of a
marked article, and sorts the suffixes by their first ``RUN`` tokens (prefix doubling). Neighbours of
equal rank have a common prefix of at least that: repeated substrings. Where one occurs on at least ``LEAST_PAGES`` pages of
different content of the host, the tokens it covers are boilerplate. Which tokens repeats of ``RUN`` or more
tokens cover doesn't depend on how long they are, as every part of ``RUN`` tokens of a longer repeat is one: the
suffixes need no further sorting. What remains are unique runs. For a host of several shards the pages
of each run are counted over the whole host by 64-bit hashes of the runs, and the runs found are given back to
its shards; that is left out where no page of the host has a block to decide on.

Repetition alone can't give right results: menus and footers may be unique to a page, and an
article may be copied or quoted across a host. So the structure decides first: scripts,
styles, navigation, page headers, footers, asides, forms, adverts, notices and comments (by
element, role and names of class and id) are dropped; what a page marks as its article
(``article`` or ``main``) is kept, repeats too. The array decides on all other blocks, beside an article
and on pages without one: covered runs of at least ``RUN`` tokens of a block and blocks covered as a whole are removed; all
other tokens stay, however few are left of a block. Where names of classes would leave nothing of a page, they
don't count.

Defined results: a null or empty html has an empty text; a null url or one without a host
belongs to the host ''; broken markup never fails and takes linear time (an unclosed element ends with its
parent, an unclosed comment, script or style with the page, a tag with an unclosed quote at the next >, a
tag without end is text); repeated rows count as one page
for repetition and each give a row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded, materialise, table
from .ngram_join import runs_of, words_of

SHARD_PAGES, SHARD_BYTES, RUN, LEAST_PAGES = 256, 16 << 20, 8, 3
#: Open elements that a new block looks through for one that it ends.
LOOK_BACK = 64

MARK = re.compile(r"[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[^a-z0-9]+")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "canvas"}
RAW_END = {tag: re.compile(rf"</{tag}", re.I | re.A) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head nav footer aside form menu dialog button select fieldset label audio video map".split())
ARTICLE = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar", "alertdialog"}
#: Names of class or id, or their last parts. Around an article the first may just describe a layout.
LAYOUT = set("sidebar nav navbar navigation menu header footer banner masthead topbar widget widgets".split())
UNWANTED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer breadcrumb breadcrumbs "
    "comment comments commentlist replies reply disqus discussion respond share sharing social related recommended newsletter subscribe subscription popup modal overlay login signin signup pager pagination toolbar skip copyright hidden".split()
)
#: These also as first parts, and first parts of names that say the contrary.
FIRST = set("ad ads advert advertisement sponsored cookie cookies gdpr consent comment comments newsletter breadcrumb breadcrumbs".split())
CONTRARY = set("no not non has with without hide toggle js".split())
#: Elements that end when a block begins beside them.
SELF_CLOSING = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}}
KEEP, SOFT, HARD = range(3)


def _named(names: str) -> int:
    """How an element of these class names or ids is to be dropped."""
    how = KEEP
    for name in names.split():
        parts = [x for x in PARTS.split(name) if x]
        if not parts or parts[0] in CONTRARY and len(parts) > 1:
            continue
        if parts[-1] in UNWANTED or parts[0] in FIRST:
            return HARD
        if parts[-1] in LAYOUT:
            how = SOFT
    return how


def _unwanted(tag: str, attributes: str, inside: bool, named: bool) -> int:
    """How an element is to be dropped; inside: it is part of an article; named: its class and id count."""
    if tag in DROPPED or tag == "header" and not inside:
        return HARD
    if not attributes or attributes.isspace():
        return KEEP
    found = {k.lower(): entities.unescape(a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return HARD
    if found.get("role") in ROLES:
        return HARD
    if not named or tag in ("html", "body"):
        return KEEP
    how = _named(f"{found.get('class', '')} {found.get('id', '')}")
    return KEEP if how == SOFT and (inside or tag in ARTICLE) else how


def tokens_of(page: str):
    """Of a page in order: (None, text), (name, attributes) of start tags and ("/" + name, "") of end tags, without comments and raw elements. Linear in its length."""
    at, end, last = 0, len(page), page.rfind(">")
    quotes = True  # until a quoted value was found without end
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            yield None, page[at:stop]
            at = stop
        elif at > last:  # no tag ends any more
            yield None, page[at:]
            return
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
        elif not (m := NAME.match(page, at + 1 + (closing := page.startswith("/", at + 1)))):
            yield None, "<"
            at += 1
        else:
            stop = m.end()
            while quotes and (found := MARK.search(page, stop)) and found[0] != ">":
                stop = page.find(found[0], found.end()) + 1
                quotes = stop > 0
            if quotes and not found:
                quotes = False
            stop = found.start() if quotes else page.find(">", m.end())
            tag = m[0].lower()
            at = stop + 1
            if closing:
                yield "/" + tag, ""
            elif tag not in RAW:
                yield tag, page[m.end() : stop]
            elif page[stop - 1] != "/":
                close = RAW_END[tag].search(page, at)
                at = close.start() if close else end


def blocks(page: str, named: bool = True) -> list[tuple[str, int]]:
    """Blocks of a page in order: text, and 0 dropped, 1 to be decided on, 2 part of a marked article."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    opened: Counter = Counter()
    drop, article, by_name = KEEP, False, False

    def flush() -> None:
        if text and (joined := " ".join("".join(text).split())):
            out.append((joined, 0 if drop else 2 if article else 1))
        text.clear()

    def last(tag: str) -> int:
        i = len(stack) - 1
        while stack[i][0] != tag:
            i -= 1
        return i

    def cut(i: int) -> None:
        nonlocal drop, article
        for name, _, _ in stack[i:]:
            opened[name] -= 1
        del stack[i:]
        drop, article = stack[-1][1:] if stack else (KEEP, False)

    for tag, rest in tokens_of(page):
        if tag is None:
            text.append(entities.unescape(rest) if "&" in rest else rest)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCKS:
                flush()
            if opened[tag]:
                flush()
                cut(last(tag))
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            flush()
            while tag == "body" and opened["head"]:
                cut(last("head"))
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - LOOK_BACK), -1):
                name = stack[i][0]
                if name in SELF_CLOSING:
                    if tag in SELF_CLOSING[name]:
                        cut(i)
                        break
                elif name in BLOCKS:
                    break
        if tag in VOID:
            continue
        how = _unwanted(tag, rest, article, named)
        by_name = by_name or how != KEEP and named
        if how or tag in BLOCKS or tag in DROPPED:
            if how and tag not in BLOCKS:
                flush()
            begins = tag in ARTICLE and how == KEEP and drop != HARD
            stack.append((tag, KEEP, True) if begins else (tag, max(drop, how), article))
            opened[tag] += 1
            drop, article = stack[-1][1:]
    flush()
    if by_name and not any(kind for _, kind in out):
        return blocks(page, False)
    return out


def covering(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens the runs that begin at starts cover."""
    change = np.zeros(n + run + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    return np.cumsum(change)[:n] > 0


def run_hashes(tokens: list[str], run: int = RUN) -> np.ndarray:
    """64-bit hashes of all runs of a token stream, in order."""
    if len(tokens) < run:
        return np.zeros(0, np.int64)
    return runs_of(words_of([" ".join(tokens)])[0], run).view(np.int64)


def parsed(page: str) -> tuple[list[tuple[str, int]], list[str], bool]:
    """Blocks of a page, the token stream of those outside of a marked article, and whether any of them is to be decided on."""
    found = blocks(page)
    return found, [t for text, kind in found if kind != 2 for t in text.split(" ")], any(kind == 1 for _, kind in found)


def repeated(pages: list[list[str]], run: int = RUN, least_pages: int = LEAST_PAGES) -> list[np.ndarray]:
    """For token streams of pages of different content, where a repeated substring covers the tokens."""
    number: dict[str, int] = {}
    streams = [np.array([number.setdefault(t, len(number)) for t in p], np.int64) for p in pages]
    sizes = np.array([len(s) for s in streams])
    covered = [np.zeros(n, bool) for n in sizes]
    if len(pages) < least_pages or not sizes.sum():
        return covered
    # A border after each page, different from all tokens and all other borders.
    tokens = np.concatenate([x for i, s in enumerate(streams) for x in (s, [len(number) + i])])
    page = np.repeat(np.arange(len(pages)), sizes + 1)
    rank, k = tokens, 1
    while k < run:  # ranks by k tokens become ranks by up to 2k
        step = min(k, run - k)
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-step] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead + 1, return_inverse=True)
        k += step
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    fresh = np.diff(r, prepend=-1) != 0
    distinct = np.add.reduceat(fresh | (np.diff(p, prepend=-1) != 0), first)
    starts = order[np.repeat(distinct >= least_pages, np.diff(np.append(first, len(r))))]
    hit = covering(starts, len(tokens), run)
    ends = np.cumsum(sizes + 1)
    return [hit[e - n - 1 : e - 1] for e, n in zip(ends, sizes)]


def unique_runs(tokens: list[str], hit: np.ndarray, run: int = RUN) -> list[str]:
    """Tokens of a block without its covered runs; one shorter than run counts only if it is the whole block."""
    if hit.all():
        return []
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    keep = np.ones(len(tokens), bool)
    for a, b in edges.reshape(-1, 2).tolist():
        keep[a:b] = b - a < run
    return [t for t, k in zip(tokens, keep) if k]


def main_texts(pages: list[str], frequent: np.ndarray | None = None) -> list[str]:
    """Main texts of the pages of a shard; frequent: hashes of the repeated runs of its host, if it has other shards."""
    different = list(dict.fromkeys(pages))
    read = [parsed(p) for p in different]
    if frequent is None:
        hits = repeated([stream for _, stream, _ in read])
    else:
        hits = [covering(np.flatnonzero(np.isin(run_hashes(stream), frequent)), len(stream), RUN) for _, stream, _ in read]
    texts = {}
    for page, (found, _, _), hit in zip(different, read, hits):
        out, at = [], 0
        for text, kind in found:
            if kind == 2:
                out.append(text)
                continue
            tokens = text.split(" ")
            here = hit[at : at + len(tokens)]
            at += len(tokens)
            if kind == 1 and (left := unique_runs(tokens, here)):
                out.append(" ".join(left))
        texts[page] = "\n\n".join(out)
    return [texts[p] for p in pages]


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host)
    most = F.greatest(F.count(F.lit(1)) / shard_pages, F.sum(F.octet_length("html")) / SHARD_BYTES)
    shards = rows.groupBy("host").agg(F.ceil(most).alias("shards"))
    dealt = rows.join(bounded(shards), "host").withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.col("shards")))

    def texts_of(group: pa.Table, frequent: np.ndarray | None) -> pa.Table:
        texts = main_texts(group.column("html").to_pylist(), frequent)
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    def run(pages: pa.Table, runs: pa.Table) -> pa.Table:
        several = pages.num_rows and pages.column("shards")[0].as_py() > 1
        return texts_of(pages, runs.column("run").to_numpy() if several else None)

    runs = frequent_runs(dealt.where("shards > 1"))
    return dealt.groupBy("host", "shard").cogroup(runs.groupBy("host", "shard")).applyInArrow(run, "page_id long, url string, text string, n_chars long")


def frequent_runs(dealt: DataFrame) -> DataFrame:
    """(host, shard, run) of dealt pages (host, shard, html): runs on at least LEAST_PAGES pages of the host that a page of the shard with blocks to decide on has."""

    def open_hosts(batches):
        for batch in batches:
            for part in slices(batch):
                open_ = [parsed(p)[2] for p in part.column("html").to_pylist()]
                yield part.select(["host"]).filter(pa.array(open_, pa.bool_()))

    def runs(batches):
        for batch in batches:
            for part in slices(batch):
                read = [parsed(p) for p in part.column("html").to_pylist()]
                found = [np.unique(run_hashes(stream)) for _, stream, _ in read]
                at = pa.array(np.repeat(np.arange(len(found)), [len(r) for r in found]))
                open_ = pa.array([o for _, _, o in read], pa.bool_()).take(at)
                yield pa.RecordBatch.from_arrays([part.column("host").take(at), part.column("shard").take(at), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), open_], names=["host", "shard", "run", "open"])

    hosts = materialise(dealt.select("host", "html").mapInArrow(open_hosts, "host string").distinct())
    pages = dealt.join(bounded(hosts), "host", "left_semi")
    schema = "host string, shard long, run long, open boolean"
    # Pages of the same content count once, wherever they were dealt.
    once = pages.groupBy("host", F.sha2("html", 256).alias("key")).agg(F.min("shard").alias("shard"), F.min("html").alias("html"))
    counts = once.select("host", "shard", "html").mapInArrow(runs, schema).groupBy("host", "run").agg(F.count(F.lit(1)).alias("pages"))
    needed = pages.select("host", "shard", "html").mapInArrow(runs, schema).where("open").select("host", "shard", "run").distinct()
    return needed.join(counts.where(F.col("pages") >= LEAST_PAGES), ["host", "run"]).select("host", "shard", "run")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
