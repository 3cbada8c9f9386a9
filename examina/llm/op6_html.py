"""Main text of web pages: element rules find what is marked, a host suffix array what a host repeats.

Elements and class names that say menu, header, footer, sidebar, notice, advert, form,
script, style or comment are left out, and of a page that marks an article only that
stays. What is left is a page's token stream. Of every host the streams of its distinct
pages are dealt to shards of bounded size; a shard concatenates its streams, with a
separator of its own after each page, and sorts their suffixes by prefix doubling to depth
MIN_RUN: neighbours that agree so far are runs of MIN_RUN tokens that repeat.

A run is the host's boilerplate if it stands on a share of the host's distinct pages.
Such a run has that share in at least one shard, so the runs that have it in some shard
are candidates; they are then counted in every shard, and the sums don't depend on how
pages were dealt. A block whose tokens all lie under boilerplate goes; others stay whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Tokens of a run that counts as repeated.
MIN_RUN = 6
#: Distinct pages of a host that a run of boilerplate stands on, and the share of them: on pages without an article, and inside articles, where passages that some pages quote are content.
PLAIN, ARTICLE = (3, 0.5), (10, 0.6)
#: Characters of text and pages that a shard has about: they bound a task's work and don't change results.
SHARD_CHARS, SHARD_PAGES = 2_000_000, 8

#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page's own.
DROPPED = frozenset("aside audio button canvas datalist dialog footer head iframe input label legend menu nav noscript object option select svg template textarea title video".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what isn't the article.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer form masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Marks of reader comments, which may be articles themselves.
COMMENTS = frozenset("comment comments disqus".split())
#: What follows a mark in names of the same things.
THINGS = frozenset("area bar block body box buttons container content group holder icons inner item items links list module panel placeholder posts row section slot unit widget widgets wrap wrapper".split())
#: What may end a name without changing what it names.
PLACES = frozenset("bottom desktop fixed inline large left main middle mobile primary right secondary small sticky top".split())
#: What begins a name that only says what else the page has.
STATES = frozenset("has hide is js no non not show with without".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed|noframes)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'](?=[^\"']*>))*)(?:>|\Z)|[^<]+|<", re.S | re.I)
#: Headings, whose ids are made from their own words.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[_:-]+|(?<=[a-z])(?=[A-Z])")
_MAIN = re.compile(r"(?<![\w-])role\s*=\s*[\"']?main\b", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def mark(attributes: str, ids: frozenset | None = None) -> str | None:
    """The word that marks an element by its class, id or role; of ids only those count
    that `ids` holds, if it is given.

    A name marks if its last word does (site-footer), places at its end aside, or if its
    first does and all others name a thing (comment-list). has-sidebar and related-work
    mark nothing.
    """
    for m in _NAMES.finditer(attributes):
        known = MARKS if ids is None or m[1].lower() != "id" else ids
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [p for p in _PARTS.split(name) if p]
            parts = [p.lower() for p in parts]
            while len(parts) > 1 and (parts[-1] in PLACES or parts[-1].isdigit()):
                parts.pop()
            if not parts or parts[0] in STATES:
                continue
            if parts[-1] in known:
                return parts[-1]
            if parts[0] in known and all(p in THINGS for p in parts[1:]):
                return parts[0]
    return None


def blocks(source: str | None) -> list[tuple[bool, list[str]]]:
    """The blocks of a page that may be content: whether each is in an article, and its
    words with character references decoded.

    A marked element that an article begins in only wraps it, as a form that a heading
    begins in does: such marks count for nothing. Nor do ids of headings and, in articles,
    of sections, which are made from their own words. Comments stay marked. An article of
    which marks would leave nothing keeps all but comments.
    """
    found: list[tuple[bool, list[str], tuple[int, ...]]] = []
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []  # name, dropped, marks, article
    kinds: list[str] = []
    wrappers: set[int] = set()
    text: list[str] = []

    def end() -> None:
        if text:
            own = html.unescape("".join(text)).split()
            if own:
                found.append((bool(stack) and stack[-1][3], own, stack[-1][2] if stack else ()))
            text.clear()

    for m in _TOKEN.finditer(source or ""):
        name = m[3]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if not (stack and stack[-1][1]):
                    text.append(m[0])
            continue
        name = name.lower()
        if name in BLOCKS:
            end()
        if m[2]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name == "br":
            text.append(" ")
        if name in VOID:
            continue
        closes = _CLOSES.get(name, ())
        if name in BLOCKS:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in closes or (stack[-1][0] in ("b", "i", "em", "strong", "a", "span", "font") and any(s[0] == "p" for s in stack))):
                stack.pop()
        dropped, marks, article = stack[-1][1:] if stack else (False, (), False)
        if m[4].rstrip().endswith("/") and name not in BLOCKS:
            continue
        ids = frozenset() if name in HEADINGS else COMMENTS if article and name == "section" else None
        own = mark(m[4], ids) if "=" in m[4] and name not in ("body", "html") else None
        if name in ("article", "main") or "role" in m[4] and _MAIN.search(m[4]):
            if own not in COMMENTS:
                own, article = None, True
                wrappers.update(k for k in marks if kinds[k] not in COMMENTS)
        elif name == "h1":
            wrappers.update(k for k in marks if kinds[k] == "<form>")
        if own is None and name == "form":
            own = "<form>"
        if own is not None and name in BLOCKS:
            marks = (*marks, len(kinds))
            kinds.append(own)
        dropped = dropped or name in DROPPED or name == "header" and not article or own is not None and name not in BLOCKS
        stack.append((name, dropped, marks, article))
    end()
    kept = [(article, own) for article, own, marks in found if wrappers.issuperset(marks)]
    if not kept:
        kept = [(article, own) for article, own, marks in found if article and not any(kinds[k] in COMMENTS for k in marks)]
    return kept


def content(source: str | None) -> tuple[bool, str]:
    """Whether a page marks an article, and its blocks, a line each: those of the article, else all."""
    found = blocks(source)
    article = any(a for a, _ in found)
    return article, "\n".join(" ".join(own) for a, own in found if a or not article)


def runs(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the concatenated streams, sorted to depth `run`: the order of
    suffixes, each one's group of equal runs, the distinct streams of every group, and
    where each stream ends in the concatenation."""
    sizes = np.array([len(s) + 1 for s in streams])
    n = int(sizes.sum())
    page = np.repeat(np.arange(len(streams)), sizes)
    rank = np.empty(n, np.int64)
    ends = np.cumsum(sizes) - 1
    inside = np.ones(n, bool)
    inside[ends] = False
    rank[inside] = np.concatenate(streams) if n > len(streams) else []
    rank[ends] = (rank[inside].max() + 1 if inside.any() else 0) + np.arange(len(ends))  # each separator once
    depth = 1
    while depth < run:  # rank: of the suffix by its first `depth` tokens
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        _, rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)
        depth += step
    order = np.lexsort((page, rank))  # the suffix array, by page where suffixes agree
    new_run = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    new_page = new_run | np.concatenate([[True], page[order][1:] != page[order][:-1]])
    group = np.cumsum(new_run) - 1
    return order, group, np.bincount(group, weights=new_page).astype(np.int64), ends


def under(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens lie under a run that begins at one of starts."""
    change = np.zeros(n + run + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    return np.cumsum(change)[:n] > 0


def covered(streams: list[np.ndarray], run: int, at_least: float) -> list[np.ndarray]:
    """For each page's token numbers, which stand under a run that at_least pages have."""
    order, group, pages, ends = runs(streams, run)
    found = under(order[pages[group] >= at_least], len(order), run)
    return [found[e - len(s) : e] for e, s in zip(ends, streams, strict=True)]


def hashes(tokens: list[str]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join([xxh64_digest(t) for t in tokens]), ">u8").astype(np.uint64)


def windows(tokens: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """A number for every run of tokens (hashes), the same wherever it stands."""
    n = max(0, len(tokens) - run + 1)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = (out + tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def least(pages: int, rule: tuple[int, float]) -> int:
    return max(rule[0], int(np.ceil(round(rule[1] * pages, 6))))


def repeated(texts: list[str], pages: int, at_least: int) -> np.ndarray:
    """The runs that as large a share of texts has as at_least is of pages."""
    numbers: dict[str, int] = {}
    streams = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.int64) for t in texts]
    order, group, counts, ends = runs(streams, MIN_RUN)
    first = order[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))]  # one place of every run
    whole = ends[np.searchsorted(ends, first)] - first >= MIN_RUN
    first = first[whole & (counts * pages >= at_least * len(texts))]
    if not len(first):
        return np.empty(0, np.int64)
    by_number = np.append(hashes(list(numbers)), np.uint64(0))
    whole_stream = np.full(len(order), len(numbers), np.int64)
    for e, s in zip(ends, streams, strict=True):
        whole_stream[e - len(s) : e] = s
    return windows(by_number[whole_stream])[first]


def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress


def _unpacker():
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return lambda raw: unpack(raw).decode("utf-8", "surrogatepass")


PARSED = "page_id bigint, url string, host string, article boolean, chars bigint, digest bigint, first boolean, packed binary"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host of every row, and its content, packed; first: false where the
    task saw the same content of that host before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        pack, seen = _packer(), set()
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                rows = []
                for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    article, text = content(source)
                    raw = text.encode("utf-8", "surrogatepass")
                    digest = xxh64_intdigest(raw) - (1 << 63)
                    first = (host, digest) not in seen
                    if first and len(seen) < 500_000:  # beyond it a task sends copies again; they are dropped where they meet
                        seen.add((host, digest))
                    rows.append((article, len(text), digest, first and bool(text), pack(raw)))
                new = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["page_id", "url", "host", "article", "chars", "digest", "first", "packed"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.select("page_id", "url", host.alias("host"), "html").mapInArrow(run, PARSED)


def boilerplate(of: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """host, run, n: the runs that enough distinct pages of a host have, and how many; of
    what `parsed` gave. A host's candidates come from the suffix arrays of its shards."""
    distinct = of.where("first")
    hosts = (distinct.groupBy("host").agg(F.count_distinct("digest").alias("pages"), F.sum("chars").alias("chars"), F.bool_and("article").alias("articles"))
             .where(F.col("pages") >= F.when(F.col("articles"), ARTICLE[0]).otherwise(PLAIN[0])))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("chars") / shard_chars), F.floor(F.col("pages") / SHARD_PAGES)))
    hosts = written(hosts.select("host", "pages", "articles", shards.alias("shards")), "hosts")

    def group(shard):
        return F.xxhash64("host", shard).alias("group")  # one key of both: rows that lie by host would be grouped where they are

    dealt = distinct.join(hosts, "host").select(group(F.pmod(F.xxhash64("digest"), "shards")), "host", "pages", "articles", "digest", "packed")

    def texts(t: pa.Table) -> list[str]:
        _, at = np.unique(t["digest"].to_numpy(), return_index=True)  # of copies one
        unpack = _unpacker()
        return [unpack(raw) for raw in t["packed"].take(pa.array(at)).to_pylist()]

    def candidates(t: pa.Table) -> pa.Table:
        pages, articles, host = (t[c][0].as_py() for c in ("pages", "articles", "host"))
        found = repeated(texts(t), pages, least(pages, ARTICLE if articles else PLAIN))
        return pa.table({"host": pa.array([host] * len(found), pa.string()), "run": found})

    found = written(dealt.groupBy("group").applyInArrow(candidates, "host string, run bigint").distinct(), "candidates")

    def counts(t: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(t) or not len(wanted):
            return pa.table({"host": pa.array([], pa.string()), "run": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        have, n = np.unique(wanted["run"].to_numpy()), np.zeros(len(wanted), np.int64)
        for text in texts(t):
            own = np.unique(windows(hashes(text.split())))
            at = np.minimum(np.searchsorted(have, own), len(have) - 1)
            n[at[have[at] == own]] += 1
        return pa.table({"host": pa.array([t["host"][0].as_py()] * len(have), pa.string()), "run": have, "n": n[: len(have)]})

    of_hosts = found.select("host").distinct()
    everywhere = found.join(hosts, "host").select("host", "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"))
    summed = (dealt.join(of_hosts, "host", "left_semi").groupBy("group").cogroup(everywhere.select(group(F.col("shard")), "run").groupBy("group"))
              .applyInArrow(counts, "host string, run bigint, n bigint").groupBy("host", "run").agg(F.sum("n").alias("n")))
    limit = F.when(F.col("articles"), F.greatest(F.lit(ARTICLE[0]), F.ceil(F.round(ARTICLE[1] * F.col("pages"), 6)))).otherwise(F.greatest(F.lit(PLAIN[0]), F.ceil(F.round(PLAIN[1] * F.col("pages"), 6))))
    return summed.join(hosts, "host").where(F.col("n") >= limit).select("host", "pages", "run", "n")


def cut(text: str, article: bool, pages: int, run: np.ndarray, n: np.ndarray) -> str:
    """The text less the blocks that lie under boilerplate (runs, ascending, and the pages
    that have each); a text of nothing else stays."""
    lines = [line.split(" ") for line in text.split("\n")]
    number = windows(hashes([w for own in lines for w in own]))
    at = np.minimum(np.searchsorted(run, number), len(run) - 1)
    starts = np.flatnonzero((run[at] == number) & (n[at] >= least(pages, ARTICLE if article else PLAIN)))
    sizes = [len(own) for own in lines]
    gone = under(starts, sum(sizes), MIN_RUN)
    whole = np.logical_and.reduceat(gone, np.cumsum([0, *sizes[:-1]]))
    return text if whole.all() else "\n".join(" ".join(own) for own, w in zip(lines, whole, strict=True) if not w)


def main_text(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; other columns of any name go.

    Null html gives an empty text, as a page without content does; pages with a null url or
    one without a host are a host of their own. Copies of a page count once for what
    repeats, and each keeps its row and its text. Texts of any length are whole. A host's
    boilerplate is joined to its pages as one list: it is at most twice as long as the
    host's mean page, as every run in it stands on half of the pages or more.
    """
    of = written(parsed(pages), "parsed")
    lists = boilerplate(of, shard_chars).groupBy("host").agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("run", "n"))).alias("runs"))
    joined = of.join(written(lists, "boilerplate"), "host", "left").select("page_id", "url", "article", "packed", "pages", F.col("runs.run").alias("run"), F.col("runs.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker()
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                texts = []
                for k, (article, raw, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    text = unpack(raw)
                    if text and n is not None:
                        text = cut(text, article, n, batch.column(5)[k].values.to_numpy(), batch.column(6)[k].values.to_numpy())
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
