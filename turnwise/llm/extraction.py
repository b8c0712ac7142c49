"""Main text of HTML pages: the blocks of the article, without the runs that its host repeats across pages.

The token streams of a host's pages are laid end to end, block by block, and their suffixes are grouped by what they begin with,
which is what the neighbours in a suffix array have in common. Only long common prefixes matter, so the array is a sparse one:
of every LONG words in a row one suffix is taken, the one whose first DEPTH words have the least hash. Two pages that share LONG
words take the same suffix there, so none is missed. Suffixes that enough distinct pages of the host share are then looked up
with all LONG words, and what those cover is taken out. Groups are counted by partial sums, so that a host of a third of all
pages is spread by its suffixes."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.arrowtext import mixed, words_of
from turnwise.llm.common import Scratch

#: Elements whose content is never the article's.
DROPPED = frozenset("head title nav header footer aside form script style noscript template svg math iframe object button select option textarea dialog menu".split())
#: Elements whose content isn't markup; they end only at their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Of the words below, those that mark a part even inside the article.
INNER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices "
    "popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus reply replies social share sharing related recommended complementary contentinfo pagination pager "
    "commentlist commentform adsbygoogle adbox adslot adunit sidenav topnav subnav mainnav sitenav sitefooter siteheader pagefooter pageheader cookiebar gdpr".split()
)
_THREADS = frozenset("comment comments reply replies".split())
#: Words in class, id or role that mark a part of the page beside its article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus reply replies "
    "social share sharing related recommended complementary contentinfo search toolbar pagination pager legal copyright "
    "commentlist commentform adsbygoogle adbox adslot adunit sidenav topnav subnav mainnav sitenav sitefooter siteheader pagefooter pageheader cookiebar gdpr disclaimer feedback aside".split()
)
#: A name of several words marks a part if its last word does, unless its first is one of STATES (has-sidebar), or if its first word
#: does and its last is one of PARTS (ad-slot, but not comments-open, widget-text or nav-free).
STATES = frozenset("has no not with without is show hide hidden non after before js".split())
PARTS = frozenset(
    "area bar block body box button buttons card cards column container content form frame group holder inner item items left links list main panel popup posts row section slot stories strip title top unit widget wrap wrapper right bottom primary secondary site page global".split()
)
#: A part by its marks alone that holds this many times the unmarked text of a page isn't beside it, unless it is one of BESIDE.
VOIDED = 10
BESIDE = frozenset("comment comments commentlist reply replies respond disqus menu nav navbar navigation sidebar footer related recommended breadcrumb breadcrumbs cookie cookies consent ad ads advert adverts advertisement advertising sponsored".split())
#: Words by whose hash a suffix is chosen, and the least words of a run that is taken out of a longer block.
DEPTH, LONG = 8, 24
#: A run is repeated if at least this many distinct pages of a host hold it, and at least one in SHARE of all of them.
LEAST_PAGES, SHARE = 3, 2
#: Hashes of repeated runs in one broadcast, 8 bytes each; more of them are joined to the pages.
MAX_BROADCAST = 2_000_000

#: The rest of a tag: values in quotes after = may hold >; a quote that nothing closes is a character like others.
_REST = re.compile(r"(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PAIR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


def _attributes(text: str) -> dict[str, str]:
    """Names in lower case and their values; of a repeated name the first."""
    out: dict[str, str] = {}
    for m in _PAIR.finditer(text):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _marks_of(found: dict[str, str]) -> frozenset[str]:
    """The words of class, id and role that can mark a part: names of one word, and of longer names the one that says what it is."""
    out = set()
    for k in ("class", "id", "role"):
        for name in found.get(k, "").lower().split():
            words = [w for w in _SPLIT.split(name) if w]
            if len(words) == 1:
                out.add(words[0])
            elif words and words[0] not in STATES:
                out.add(words[-1])
                if words[-1] in PARTS:
                    out.add(words[0])
    return frozenset(out)


def _is_main(tag: str, found: dict[str, str]) -> bool:
    return tag in ("article", "main") or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"


def blocks(page: str, void: frozenset[int] = frozenset(), wrappers: list[list[int]] | None = None) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks in order. Kind 0: inside the article; 1: unmarked; 2: in a part beside it; 3: inside an
    article that a marked part holds. Time is linear in the page, however broken its markup.

    void: places of tags in the page whose marks don't count. wrappers gets [place, characters, may be void] of every outermost
    part by its marks."""
    out: list[tuple[str, int]] = []
    marked: list[list[int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # tag, what it starts: 0 nothing, 1 a part beside, 2 one by its marks outside the article, 3 the article
    open_tags: Counter[str] = Counter()
    starts = [0, 0, 0, 0]
    at, size, loose = 0, len(page), False

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                if starts[2] and not starts[1] and not starts[3]:
                    marked[-1][1] += len(text)
                out.append((text, 2 if starts[1] else (3 if starts[2] else 0) if starts[3] else 2 if starts[2] else 1))

    def close(down_to: int) -> None:
        if any(k for _, k in stack[down_to:]):
            flush()
        for tag, k in stack[down_to:]:
            open_tags[tag] -= 1
            starts[k] -= 1
        del stack[down_to:]

    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            held.append(page[at:])
            break
        if sign > at:
            held.append(page[at:sign])
        m = _NAME.match(page, sign + 1)
        if m is None:
            if page.startswith("<!--", sign):
                end = page.find("-->", sign + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), sign):
                end = page.find(">", sign)
                at = size if end < 0 else end + 1
            else:
                held.append("<")
                at = sign + 1
            continue
        end = None if loose else _REST.match(page, m.end())
        if end is not None:
            at = end.end()
        else:  # no > outside quotes: from here on a tag ends at the next >
            loose = True
            found = page.find(">", m.end())
            at = size if found < 0 else found + 1
            if found < 0:
                break
        tag, rest = m[2].lower(), page[m.end() : at - 1]
        if tag == "br":
            held.append(" ")
            continue
        plain = tag in INLINE
        if not plain:
            flush()
        if m[1]:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID or rest.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            last = _ENDS[tag].search(page, at)
            closing = page.find(">", last.end()) if last else -1
            at = size if closing < 0 else closing + 1
            continue
        named = _attributes(rest) if rest else {}
        marks = _marks_of(named) if named else frozenset()
        kind = 0
        if tag in DROPPED or "hidden" in named or named.get("aria-hidden", "").lower() == "true":
            kind = 1
        elif tag in ("html", "body"):
            kind = 0
        elif _is_main(tag, named):
            kind = (1 if starts[3] else 2) if tag == "article" and not _THREADS.isdisjoint(marks) else 3
        elif starts[3]:
            kind = 0 if INNER.isdisjoint(marks) else 1
        elif not MARKS.isdisjoint(marks) and sign not in void:
            kind = 2
            if not starts[2]:
                flush()
                marked.append([sign, 0, BESIDE.isdisjoint(marks)])
        if kind and plain:
            flush()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        stack.append((tag, kind))
        open_tags[tag] += 1
        starts[kind] += 1
    flush()
    if wrappers is not None:
        wrappers += marked
    return out


def article(page: str) -> list[str]:
    """The blocks that may be the page's main text: those inside its article. Without one, those of an article inside a marked
    part or the unmarked blocks, whichever have more text. A mark round nearly all text of a page without an article is void; so
    are marks inside of it that hold nearly all of the rest, as often as that is so, eight times at most."""
    void: frozenset[int] = frozenset()
    for _ in range(8):
        wrappers: list[list[int]] = []
        found = blocks(page, void, wrappers)
        largest = max((w for w in wrappers if w[2]), key=lambda w: w[1], default=None)
        if largest is None or any(x in (0, 3) for _, x in found) or largest[1] <= VOIDED * sum(len(t) for t, x in found if x == 1):
            break
        void |= {largest[0]}
    of = {k: [t for t, x in found if x == k] for k in (0, 1, 3)}
    return of[0] or max(of[3], of[1], key=lambda x: sum(map(len, x)))


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


class _Streams:
    """The token streams of some pages, laid end to end: word hashes, and from them hashes of blocks, suffixes and runs."""

    def __init__(self, pages: list[list[str]], urls: list[str | None]):
        self.pages = pages
        blocks_of = [len(p) for p in pages]
        texts = [b for p in pages for b in p]
        self.page_of_block = np.repeat(np.arange(len(pages)), blocks_of)
        words, self.block = words_of(np.frombuffer("\n".join(texts).encode(errors="replace"), np.uint8))
        self.words, self.page = words, self.page_of_block[self.block] if len(words) else np.zeros(0, np.int64)
        hosts = np.array([np.frombuffer(hashlib.blake2b(_host(u).encode(errors="replace"), digest_size=8).digest(), np.uint64)[0] for u in urls], np.uint64)
        self.hosts = hosts
        self.first = np.searchsorted(self.block, np.arange(len(texts)))
        self.count = np.diff(np.append(self.first, len(words)))
        place = np.arange(len(words)) - self.first[self.block] if len(words) else np.zeros(0, np.int64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * (mixed(place + 1) | np.uint64(1)), dtype=np.uint64)))
        whole = mixed(sums[self.first + self.count] - sums[self.first] + self.count.astype(np.uint64))
        self.short = self.count < LONG
        #: Hashes of whole blocks, with their host.
        self.blocks = mixed(whole ^ hosts[self.page_of_block])

    def rolled(self, width: int) -> np.ndarray:
        n = max(0, len(self.words) - width + 1)
        out = np.zeros(n, np.uint64)
        for j, f in enumerate(mixed(np.arange(1, width + 1)) | np.uint64(1)):
            out += self.words[j : j + n] * f
        return mixed(out)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, chosen): where LONG words in a row lie in one block, and the hash of the suffix that is taken of each."""
        n = max(0, len(self.words) - LONG + 1)
        least, width, wide = self.rolled(DEPTH), 1, LONG - DEPTH + 1
        while width * 2 <= wide:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        least = np.minimum(least[:n], least[wide - width : wide - width + n])
        at = np.flatnonzero(self.block[:n] == self.block[LONG - 1 :][:n])
        return at, mixed(least[at] ^ self.hosts[self.page[at]])

    def signatures(self) -> np.ndarray:
        """A number for each page that near copies mostly share: three least hashes of four words in a row."""
        out = np.zeros(len(self.pages), np.uint64)
        np.add.at(out, self.page_of_block, self.blocks)
        grams = self.rolled(4)
        inside = self.page[: len(grams)] == self.page[3:][: len(grams)] if len(grams) else np.zeros(0, bool)
        own, grams = self.page[: len(grams)][inside], grams[inside]
        if len(grams):
            cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            total = np.zeros(len(cuts), np.uint64)
            for salt in (1, 2, 3):
                total = mixed(total + np.minimum.reduceat(mixed(grams + np.uint64(salt)), cuts))
            out[own[cuts]] = total
        return out

    def without(self, hot) -> list[str]:
        """The text of each page without its repeated blocks and runs; a page that has nothing else keeps them. hot(page numbers,
        hashes) tells which are repeated."""
        gone = self.short & hot(self.page_of_block, self.blocks)
        at, chosen = self.suffixes()
        runs = np.zeros(len(self.words) + 1, np.int64)
        if len(at):
            hit = at[hot(self.page[at], mixed(self.rolled(LONG)[at] ^ self.hosts[self.page[at]]))]
            np.add.at(runs, hit, 1)
            np.add.at(runs, hit + LONG, -1)
        covered = np.cumsum(runs)[:-1] > 0
        out, k = [], 0
        for page in self.pages:
            kept = []
            for text in page:
                a, b = self.first[k], self.first[k] + self.count[k]
                if not gone[k]:
                    kept.append(text if not covered[a:b].any() else " ".join(w for w, c in zip(text.split(" "), covered[a:b].tolist(), strict=True) if not c))
                k += 1
            out.append("\n\n".join(x for x in kept if x) or "\n\n".join(page))
        return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Streams]]:
    """Batches of page_id, url, html and what else, at most 200 rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield part, _Streams([article(x or "") for x in part.column(2).to_pylist()], part.column(1).to_pylist())


def _held_by(part: pa.RecordBatch, table) -> object:
    """hot(page numbers, hashes): from a sorted table for all pages, or from each page's own list in the last column."""
    if table is not None:
        if not len(table):
            return lambda pages, hashes: np.zeros(len(hashes), bool)
        return lambda pages, hashes: table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes
    own = [np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in part.column(part.num_columns - 1).to_pylist()]
    pairs = set((k, h) for k, x in enumerate(own) for h in x.tolist())
    return lambda pages, hashes: np.array([(p, h) in pairs for p, h in zip(pages.tolist(), hashes.tolist(), strict=True)], bool)


_ROWS = "key long, host long, run long, sig long"


def _rows(pages: DataFrame, long_runs: bool, table=None) -> DataFrame:
    """key, host, run, sig of pages (page_id, url, html, key, and hot where no table is broadcast): whole short blocks and the
    chosen suffixes; with long_runs, all LONG words in a row whose chosen suffix is hot. The host counts as a run of itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in _streams(batches):
            at, chosen = streams.suffixes()
            own = streams.page[at]
            if long_runs:
                hit = _held_by(part, None if table is None else table.value)(own, chosen)
                hashes, owner = mixed(streams.rolled(LONG)[at[hit]] ^ streams.hosts[own[hit]]), own[hit]
            else:
                fresh = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1]))) if len(chosen) else np.zeros(0, bool)
                full = np.unique(streams.page_of_block)
                hashes = np.concatenate((chosen[fresh], streams.blocks[streams.short], streams.hosts[full]))
                owner = np.concatenate((own[fresh], streams.page_of_block[streams.short], full))
            keys = part.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x[owner].view(np.int64)) for x in (keys, streams.hosts)] + [pa.array(hashes.view(np.int64)), pa.array(streams.signatures()[owner].view(np.int64))], ["key", "host", "run", "sig"])

    return pages.mapInArrow(run, _ROWS)


def _counted(rows: DataFrame) -> DataFrame:
    """run, host, n: in how many distinct pages, near copies mostly counted as one, every run of LEAST_PAGES or more is held."""
    return rows.groupBy("run", "sig").agg(F.min("host").alias("host")).groupBy("run").agg(F.min("host").alias("host"), F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}")


def _enough(counts: DataFrame, totals: DataFrame) -> DataFrame:
    return counts.join(totals, "host").where(f"n * {SHARE} >= _pages").select("run")


def _given(pages: DataFrame, hot: DataFrame, rows: DataFrame | None):
    """pages, and a broadcast of hot, a written table; where that has too many runs, pages with the ones that each page's rows hold."""
    if hot.count() <= MAX_BROADCAST:
        table = np.sort(hot.toPandas()["run"].to_numpy(dtype=np.int64).view(np.uint64))
        return pages, pages.sparkSession.sparkContext.broadcast(table)
    own = rows.join(hot, "run", "left_semi").groupBy("key").agg(F.collect_set("run").alias("hot"))
    return pages.join(own, "key", "left").select(*pages.columns, "hot"), None


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A page that marks its article (article, main) gives the blocks inside it, but for parts marked as beside it. Other pages
    give their unmarked blocks. From both, what the host repeats is taken out: a block of fewer than 24 words, or a run of 24
    words and more, that at least 3 distinct pages and half of the host's hold. Copies and most near copies count once, and
    a page that has nothing else keeps its text. Null or empty html and pages without text give an empty text; cut-off pages
    give what is there; repeated rows are alike; a null url is a host of its own, the empty one; other columns are passed over."""
    scratch = Scratch(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    held = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key"))
    rows = _rows(held, False)
    counts = scratch.write(_counted(rows), "counts")
    totals = counts.where("run = host").select("host", F.col("n").alias("_pages"))
    hot = scratch.write(_enough(counts.where("run <> host"), totals), "hot")
    if not hot.isEmpty():
        near, table = _given(held, hot, rows)
        longer = _rows(near, True, table)
        found = _enough(_counted(longer), totals)
        hot, rows = scratch.write(hot.unionByName(found), "runs"), rows.unionByName(longer)
    given, table = _given(held, hot, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in _streams(batches):
            text = streams.without(_held_by(part, None if table is None else table.value))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
