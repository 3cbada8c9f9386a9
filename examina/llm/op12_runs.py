"""Periodic runs of words: a suffix automaton whose link tree is a link-cut tree.

The automaton grows by one word at a time. The strings that end at the new word are the
path from its node to the root of the tree of suffix links; that path is recoloured with
the new end. Before, it fell into segments, each of one colour: the last end before this
one of all its strings, the longest of which has the length of the segment's lowest node.
Where the distance between both ends is no more than that length, the words repeat at
that distance over at least two periods: a square, which is extended to its run. The
segments are the preferred paths of a link-cut tree, so a word recolours a number of
them that is logarithmic in the mean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, without, words

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Passes of cutting before what is left goes to the automaton as it is; a bound of work, not of runs.
PASSES = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
COLUMNS = {"n_words": "bigint", "n_runs": "bigint", "runs": RUNS, "collapsed": "string"}


class LinkTree:
    """The tree of suffix links as splay trees, one for each preferred path. Node 0 is
    none, 1 the root. A path's colour (the last end of its strings) is kept at the root
    of its splay tree."""

    def __init__(self):
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def leaf(self, above: int) -> int:
        """A new node under `above`, a path of its own without a colour."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(above)
        self.colour.append(-1)
        return len(self.up) - 1

    def insert_above(self, x: int) -> int:
        """A new node between x and its parent, of x's path and colour."""
        self.splay(x)
        new = self.leaf(x)
        above = self.left[new] = self.left[x]
        if above:
            self.up[above] = new
        self.left[x] = new
        return new

    def splay(self, x: int) -> int:
        """Makes x the root of its splay tree; returns the path's colour."""
        left, right, up = self.left, self.right, self.up
        root = x
        while (p := up[root]) and (left[p] == root or right[p] == root):
            root = p
        colour = self.colour[root]
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            turns = ((p, x) if (left[g] == p) == (left[p] == x) else (x, x)) if inner else (x,)
            for y in turns:  # y rises above its parent
                q = up[y]
                above = up[q]
                if left[q] == y:
                    child = left[q] = right[y]
                    right[y] = q
                else:
                    child = right[q] = left[y]
                    left[y] = q
                if child:
                    up[child] = q
                up[q] = y
                up[y] = above
                if above:
                    if left[above] == q:
                        left[above] = y
                    elif right[above] == q:
                        right[above] = y
        self.colour[x] = colour
        return colour

    def recolour(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from x to the root a colour; returns the lowest node and the
        colour of each segment that it had."""
        met, below = [], 0
        right, up = self.right, self.up
        while x:
            old = self.splay(x)
            met.append((x, old))
            rest = right[x]
            if rest:
                self.colour[rest] = old
            right[x] = below
            below, x = x, up[x]
        self.colour[below] = colour
        return met


def squares_to_runs(seq: list[int]) -> list[tuple[int, int, int]]:
    """start, length, smallest period of every run of seq (at least two periods that no
    neighbour extends), by start, then period."""
    tree = LinkTree()
    follow: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    out, until, n, last = [], {}, len(seq), 1
    for i, word in enumerate(seq):
        p, above = last, 1
        while p and word not in follow[p]:
            p = link[p]
        if p:
            q = follow[p][word]
            if length[p] + 1 == length[q]:
                above = q
            else:
                above = tree.insert_above(q)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = above
                r = p
                while r and follow[r].get(word) == q:
                    follow[r][word] = above
                    r = link[r]
        node = tree.leaf(above)
        follow.append({})
        link.append(above)
        length.append(i + 1)
        r = last
        while r != p:
            follow[r][word] = node
            r = link[r]
        last = node
        for low, before in tree.recolour(node, i):
            period = i - before
            if before < 0 or period > length[low] or until.get(period, -1) >= i:
                continue
            end = i
            while end + 1 < n and seq[end + 1] == seq[end + 1 - period]:
                end += 1
            until[period] = end
            start = i - length[low] - period + 1
            out.append((start, end - start + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches outside which no run of PERIODS periods and LEAST words lies.

    In such a run every two neighbours stand beside each other PERIODS - 1 times at
    least, so a stretch is cut where two words don't, and its parts are cut again.
    """
    done, work = [], [(0, len(ids), 0)]
    while work:
        low, high, passes = work.pop()
        if high - low < LEAST:
            continue
        own = ids[low:high]
        _, where, counts = np.unique(own[:-1] * (int(own.max()) + 1) + own[1:], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[where] < PERIODS - 1)
        if not len(rare) or passes == PASSES:
            done.append((low, high))
            continue
        ends = [low, *(rare + low + 1).tolist(), high]
        work += [(a, b, passes + 1) for a, b in zip(ends, ends[1:], strict=False) if b - a >= LEAST]
    return sorted(done)


def runs_of(found: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of LEAST words and PERIODS periods, by start, then period."""
    if len(found) < LEAST:
        return []
    number = defaultdict(count().__next__)
    ids = list(map(number.__getitem__, found))
    out = []
    for low, high in stretches(np.array(ids, np.int64)):
        out += [(low + s, n, q) for s, n, q in squares_to_runs(ids[low:high]) if n >= max(LEAST, PERIODS * q)]
    return out


def collapsed_words(found: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that a run holds after its first period."""
    kept, at = [], 0
    for low, high in sorted((s + q, s + n) for s, n, q in runs):
        kept += found[at:low]
        at = max(at, high)
    return kept + found[at:]


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_runs, runs (start, length, period in words, by start, then period)
    and collapsed (each run cut to its first period, words joined by one space) to every
    row of docs; keep names the columns to pass on (all).

    A run is a longest stretch of consecutive words with a smallest period q, LEAST words
    and PERIODS * q words at least; runs may overlap, and of equal ones none is dropped.
    Null and empty texts have no word, no run and an empty collapsed text. Input columns
    with the names of added ones are left out; every row gives one row, repeated ones and
    null ids too; texts of any length are whole, and an empty table gives no row.
    """
    source = without(docs, *COLUMNS, "__text")
    kept = source.select([F.col(f"`{c}`") for c in (source.columns if keep is None else keep)])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1000):
                batch = whole.slice(i, 1000)
                rows = []
                for text in batch.column(len(names)).to_pylist():
                    found = words(text)
                    runs = runs_of(found)
                    rows.append((len(found), len(runs), runs, b" ".join(collapsed_words(found, runs)).decode("utf-8", "surrogatepass")))
                n, k, runs, texts = zip(*rows, strict=True)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(k, pa.int64()), lists, pa.array(texts, pa.string())], [*names, *COLUMNS])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept.schema.fields, *_parse_datatype_string(", ".join(f"{k} {v}" for k, v in COLUMNS.items())).fields])
    return source.select([F.col(f"`{c}`") for c in names] + [F.col("text").cast("string").alias("__text")]).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length for its period; of equal ones the first by start, then period."""
    better = lambda a, r: a["period"].isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's texts: of a tenth of all ids the words from one on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    found = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(found)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    block = F.slice(found, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    repeated = F.array_join(F.concat(F.slice(found, F.lit(1), a.cast("int")), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(WORD), repeated).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, keep=["doc_id"]).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
