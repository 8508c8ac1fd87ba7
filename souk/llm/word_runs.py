"""Maximal runs of repeated words, found on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends.
It ends with a *branching* square: two equal blocks of q words behind which the words
differ. Branching squares are read off the suffix array (SA), its inverse (ISA) and the
lengths of common prefixes of neighbours (LCP):

* an LCP interval of depth d holds the suffixes that share their first d words, its
  children part there. A suffix i starts a branching square of period d when ISA[i + d]
  lies in the interval and in another child than i;
* testing i + d and i - d for the suffixes of all children but the largest finds every
  one, with n log n tests in all;
* a square is rotated to the left as long as the words agree; squares of a multiple of
  the period that end at the same word belong to a run found before and are skipped.

No tree is built: intervals are pairs of bounds, children are cut positions. Documents
that share an Arrow batch are worked on together; the document is the first sort key, so
no interval crosses documents.

Cases: a null or wordless text has no run and an empty collapsed text; repeated rows and
repeated or null ids give one row each; an empty table gives no rows; other columns of
the input are ignored whatever their names. Of runs that share words all are reported;
ties are told apart by start, then period. Work on a text grows with n log n words and
its memory with n (a text is not cut), the pair tests are done in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship, small_batches

#: Documents are worked on together up to this many words, and pairs tested at once.
CHUNK_WORDS = 150_000
BLOCK_TESTS = 1_000_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_order(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order (document, words), and for every k the ranks by the first 2^k
    words: prefix doubling that sorts again only what is still tied. Ranks are slots of
    the group's first suffix; the entry behind the last one is -1."""
    n = len(codes)
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks, width = [rank], 1
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(slots):
        at = order[slots]
        group = rank[at].astype(np.int64)
        behind = at + width
        behind = np.where(behind < ends[at], rank[np.minimum(behind, n)], -1)
        key = group * (n + 1) + behind + 1
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[slots] = at
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        ranks.append(rank)
        width *= 2
        slots = slots[~(head & np.append(head[1:], True))]
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP[j]: words that the suffixes in slots j - 1 and j share (LCP[0] = 0)."""
    lcp = np.zeros(len(order), np.int64)
    js = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[js - 1].astype(np.int64), order[js].astype(np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
        lcp[js] += same
        a, b = a + same, b + same
    return lcp


def interval_bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every slot j with LCP[j] > 0: j, and first and last slot of the LCP interval of
    depth LCP[j] around it (nearest smaller entries on both sides)."""
    depths = lcp.tolist()
    n = len(depths)
    first, last = [0] * n, [n - 1] * n
    open_ = [0]                                   # slots of growing depth; the lowest has depth 0
    for j in range(1, n):
        d = depths[j]
        while depths[open_[-1]] > d:
            last[open_.pop()] = j - 1
        if d:
            top = open_[-1]
            first[j] = top if depths[top] < d else first[top]
            open_.append(j)
        else:
            open_[-1] = j
    js = np.flatnonzero(lcp)
    return js, np.array(first, np.int64)[js], np.array(last, np.int64)[js]


def small_children(lcp: np.ndarray) -> np.ndarray:
    """Rows (first slot, last slot of a child, first, last slot and depth of its interval)
    for all children of LCP intervals but the largest of each (of equals the last)."""
    js, first, last = interval_bounds(lcp)
    if not len(js):
        return np.zeros((0, 5), np.int64)
    depth = lcp[js]
    together = np.lexsort((js, depth, first))
    js, first, last, depth = js[together], first[together], last[together], depth[together]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])))
    starts_at = np.flatnonzero(new)                       # first cut of every interval
    ends_at = np.append(starts_at[1:], len(js))
    group = np.cumsum(new) - 1
    owner = np.insert(group, starts_at, np.arange(len(starts_at)))
    child_first = np.insert(js, starts_at, first[starts_at])
    child_last = np.insert(js - 1, ends_at, last[starts_at])
    by_size = np.lexsort((child_last - child_first, owner))
    largest = by_size[np.append(owner[by_size][1:] != owner[by_size][:-1], True)]
    rest = np.ones(len(owner), bool)
    rest[largest] = False
    owner = owner[rest]
    at = starts_at[owner]
    return np.stack((child_first[rest], child_last[rest], first[at], last[at], depth[at]), axis=1)


def branching_squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Rows (period, first word) of all branching squares, each once, by period and word."""
    kids = small_children(lcp)
    found = [np.zeros((0, 2), np.int64)]
    n = len(order)
    total = np.cumsum(kids[:, 1] - kids[:, 0] + 1)
    begin = 0
    while begin < len(kids):                              # blocks of children, a bounded number of tests each
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + BLOCK_TESTS, "right")))
        block = kids[begin:end]
        size = block[:, 1] - block[:, 0] + 1
        row = np.repeat(np.arange(len(block)), size)
        slot = block[row, 0] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        i, depth = order[slot], block[row, 4]
        for other, start in ((i + depth, i), (i - depth, i - depth)):
            ok = (other >= 0) & (other < n)
            r = inverse[np.where(ok, other, 0)]
            ok &= (r >= block[row, 2]) & (r <= block[row, 3]) & ((r < block[row, 0]) | (r > block[row, 1]))
            found.append(np.stack((depth[ok], start[ok]), axis=1))
        begin = end
    return np.unique(np.concatenate(found), axis=0)


def _left_end(codes: np.ndarray, lowest: int, start: int, period: int) -> int:
    """First word of the stretch with this period that covers the square at ``start``."""
    step = 32
    while start > lowest:
        low = max(lowest, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return start


def find_runs(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, min_length: int = 6,
              min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(first word, length, smallest period) of every run of at least ``min_length`` words
    and ``min_exponent`` (2 or more) periods, by first word and period. ``codes`` are the
    words of all documents one after the other, ``doc`` the document of every word and
    ``starts`` the first word of every document and the end of the last."""
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    if not len(codes):
        return []
    order, ranks = suffix_order(codes, doc, starts[doc + 1])
    lcp = common_prefixes(order, ranks)
    known: dict[int, list[tuple[int, int]]] = {}
    out = []
    for period, at in branching_squares(order, ranks[-1][:-1], lcp).tolist():   # smallest period first
        end = at + 2 * period
        if any(period % q == 0 and s <= at for s, q in known.get(end, ())):
            continue
        start = _left_end(codes, int(starts[doc[at]]), at, period)
        known.setdefault(end, []).append((start, period))
        if end - start >= max(min_length, min_exponent * period):
            out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that some run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def chunk_runs(texts: list[list[bytes]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of every text of a chunk, as word numbers of the text."""
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(codes, doc, starts, min_length, min_exponent):
        d = int(doc[start])
        out[d].append((start - int(starts[d]), length, period))
    return out


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row of
    ``docs`` (doc_id, text). Words are what ASCII white space separates. Nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            ids = batch.column("doc_id")
            words = [t.split() if t else [] for t in batch.column("text").to_pylist()]   # bytes.split knows ASCII only
            begin = 0
            while begin < len(words):
                end, size = begin, 0
                while end < len(words) and (end == begin or size + len(words[end]) <= CHUNK_WORDS):
                    size += len(words[end])
                    end += 1
                part = words[begin:end]
                found = chunk_runs(part, min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, end - begin), pa.array([len(w) for w in part], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found],
                             pa.list_(run_type)),
                    pa.array([collapse(w, rs) for w, rs in zip(part, found, strict=True)], pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                begin = end

    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
