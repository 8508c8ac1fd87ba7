"""Benchmark decontamination: edit-distance search by CGK embedding and bit sampling.

A document contains an item if some run of its words is within ``floor(0.2 * n)``
word edits (insert, delete, replace) of the item's ``n`` words; words are runs of
letters and digits of the lower-cased text.

1. Windows. Windows of an item's size are taken where they can match at all: a
   run within ``d`` edits of the item shares ``n - q + 1 - q * d`` of its word
   ``q``-grams on diagonals at most ``d`` apart (q-gram lemma; ``q`` is 1 to 3, as far as
   an unedited run of ``q`` words must remain). No matching window is lost here.
2. Embedding. The CGK random walk reads a window from the left and writes one
   symbol a step, staying or moving on by a random bit of (step, symbol): two
   windows at a small edit distance fall into step again after an edit, so edit
   distance becomes Hamming distance. ``WALKS`` independent walks are used.
3. Sampling LSH. Every walk has ``TABLES`` keys of ``SAMPLES`` sampled places; a
   window is a candidate for an item if a key agrees. Walks agree less often the longer
   the item is, so this step serves items of at most ``LONG`` words; of longer items
   every window that the q-gram lemma leaves is a candidate (few are left: such an
   item must share about two fifths of its 3-grams on near diagonals).
4. Every candidate is verified by the exact edit distance between the item and the
   best run of words around the window; candidates of a long item whose surroundings
   overlap are verified together, in one run.

Items are broadcast in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS``
words (counted first); a larger benchmark takes one pass over the documents per
block. Matches leave the tasks as (doc_id, text hash, item_id) rows.

Cases: null or empty texts and items, and items without a word, match nothing; an
item of fewer than five words must occur unedited; repeated items are all
reported, repeated rows get equal results; an empty table on either side gives no
match; extra columns are ignored (or kept by :func:`clean_documents`).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import held, ship, small_batches
from souk.sources.staging import stage

EDITS = 0.2
WALKS, TABLES, SAMPLES = 12, 6, 2
LONG = 64                    # words of an item; longer ones skip the sampled keys
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
BATCH_WORDS = 1_000_000
CELLS = 4_000_000            # cells of embeddings in memory at a time (one window at least)
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def allowed(n: int) -> int:
    return int(n / 5)                       # floor(EDITS * n), in whole numbers


def gram_size(n: int) -> int:
    d = allowed(n)
    return max(1, min(3, -(-(n - d) // (d + 1))))


def edit_distance(item: np.ndarray, run: np.ndarray) -> int:
    """Least word edits between the item and any contiguous part of ``run``."""
    row = np.zeros(len(run) + 1, np.int64)
    steps = np.arange(len(run) + 1)
    for k, w in enumerate(item.tolist(), 1):
        best = np.minimum(row[:-1] + (run != w), row[1:] + 1)
        row = np.concatenate(([k], best))
        row = np.minimum.accumulate(row - steps) + steps          # insertions
    return int(row.min())


def _bits(walk: int, step: int, symbols: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(walk * 1_000_003 + step * 7919 + 12345)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def embed(line: np.ndarray, start: np.ndarray, size: np.ndarray, walk: int, longest: int) -> np.ndarray:
    """CGK embeddings (windows, 3 * longest) of windows of ``line``; past a window's end -1."""
    out = np.full((len(start), 3 * longest), -1, np.int64)
    at = np.zeros(len(start), np.int64)
    for step in range(3 * longest):
        live = np.nonzero((at < size) & (step < 3 * size))[0]
        if not len(live):
            break
        symbol = line[start[live] + at[live]]
        out[live, step] = symbol
        at[live] += _bits(walk, step, symbol)
    return out


def in_parts(size: np.ndarray):
    """Places in order of size, in parts whose embeddings together have at most CELLS cells."""
    order, a = np.argsort(size, kind="stable"), 0
    while a < len(order):
        near = order[a:a + 4096]
        b = a + max(1, int(np.searchsorted(np.arange(1, len(near) + 1) * 3 * size[near], CELLS, "right")))
        yield order[a:b]
        a = b


@dataclass
class Items:
    """A block of items, prepared once per worker."""
    ids: list
    texts: list[str]

    def prepare(self) -> Items:
        split = [words_of(t) for t in self.texts]
        names = sorted({w for s in split for w in s})

        class Numbers(dict):
            def __missing__(self, key):
                return 0

        self.number = Numbers(zip(names, range(1, len(names) + 1)))       # 0: in no item
        self.base = len(names) + 1
        self.size = np.array([len(s) for s in split], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.line = np.array([self.number[w] for s in split for w in s], np.int64)
        self.edits = np.array([allowed(n) for n in self.size], np.int64)
        self.gram = np.array([gram_size(n) if n else 0 for n in self.size], np.int64)
        self.least = np.maximum(1, self.size - self.gram + 1 - self.gram * self.edits)
        self.tables = {}
        for q in (1, 2, 3):
            code, item, offset = [], [], []
            for k in np.nonzero(self.gram == q)[0]:
                line = self.line[self.begin[k]:self.begin[k] + self.size[k]]
                c = self.codes(line, q)
                code.append(c)
                item.append(np.full(len(c), k))
                offset.append(np.arange(len(c)))
            if code:
                code, item, offset = map(np.concatenate, (code, item, offset))
                order = np.argsort(code, kind="stable")
                self.tables[q] = (code[order], item[order], offset[order])
        rng = np.random.default_rng(17)
        longest = int(self.size.max(initial=0))
        self.keys = []
        for walk in range(WALKS if longest else 0):
            places = (rng.random((len(self.size), TABLES, SAMPLES)) * (2 * self.size)[:, None, None]).astype(np.int64)
            symbols = np.full(places.shape, -1, np.int64)
            short = np.nonzero(self.size <= LONG)[0]
            for part in in_parts(self.size[short]):
                k = short[part]
                symbols[k] = self.sampled(self.line, self.begin[k], k, places, walk)
            self.keys.append((places, symbols))
        return self

    def sampled(self, line: np.ndarray, start: np.ndarray, item: np.ndarray, places: np.ndarray, walk: int) -> np.ndarray:
        """The items' sampled places of the embeddings of windows of their sizes."""
        e = embed(line, start, self.size[item], walk, max(1, int(self.size[item].max())))
        p = places[item].reshape(len(item), -1)
        return np.take_along_axis(e, p, axis=1).reshape(-1, TABLES, SAMPLES)

    def codes(self, line: np.ndarray, q: int) -> np.ndarray:
        n = len(line) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(q):
            code = code * self.base + line[k:k + n]
            known &= line[k:k + n] > 0
        return np.where(known, code, -1)

    def windows(self, line: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(document, item, start) of windows that the q-gram lemma leaves."""
        docs, items, starts = [], [], []
        for q, (code, item, offset) in self.tables.items():
            c = self.codes(line, q)
            at = np.nonzero(c >= 0)[0]
            at = at[doc[at] == doc[at + q - 1]]
            lo = np.searchsorted(code, c[at], "left")
            n = np.searchsorted(code, c[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            docs.append(doc[at])
            items.append(item[pick])
            starts.append(at - offset[pick])
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        d, i, s = map(np.concatenate, (docs, items, starts))
        order = np.lexsort((s, i, d))
        d, i, s = d[order], i[order], s[order]
        # Hits of one document and item on diagonals within the allowed edits.
        group = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (i[1:] != i[:-1])))) if len(d) else d
        span = len(line) + 2 * int(self.size.max(initial=0)) + 2
        key = group * span + s + int(self.size.max(initial=0))
        near = np.searchsorted(key, key + self.edits[i], "right") - np.searchsorted(key, key - self.edits[i], "left")
        keep = near >= self.least[i]
        keep[1:] &= ~((key[1:] == key[:-1]) & keep[:-1])                  # one window of each
        return d[keep], i[keep], s[keep]

    def candidates(self, line: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Windows that agree with their item in a key of some walk, and all windows of long
        items. ``line`` has room on both sides for windows that begin before or end after a text."""
        found = self.size[item] > LONG
        for walk, (places, symbols) in enumerate(self.keys):
            left = np.nonzero(~found)[0]
            for part in in_parts(self.size[item[left]]):
                w = left[part]
                got = self.sampled(line, start[w], item[w], places, walk)
                found[w] = (got == symbols[item[w]]).all(axis=2).any(axis=1)
        return found

    def joined(self, doc: np.ndarray, item: np.ndarray, start: np.ndarray):
        """(document, item, first start, last start) of candidates, sorted: those of a long item
        whose surroundings overlap are one."""
        reach = self.size[item] + 3 * self.edits[item]
        new = np.ones(len(doc), bool)
        new[1:] = ((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (self.size[item[1:]] <= LONG)
                   | (start[1:] - start[:-1] > reach[1:]))
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(doc))[:len(first)] - 1
        return zip(doc[first].tolist(), item[first].tolist(), start[first].tolist(), start[last].tolist())

    def matches(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the numbers of the items it contains."""
        out: list[list[int]] = [[] for _ in texts]
        room = 2 * int(self.size.max(initial=0)) + 2
        k = 0
        while k < len(texts) and len(self.line):
            first, parts, sizes = k, [], []
            while k < len(texts) and sum(sizes) + room * len(sizes) < BATCH_WORDS:
                w = words_of(texts[k])
                parts.append(np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)))
                sizes.append(len(w))
                k += 1
            gap = np.zeros(room, np.int64)
            line = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
            size = np.array(sizes)
            begin = room + np.cumsum(size + room) - size - room
            doc = np.zeros(len(line), np.int64) - 1
            for j, (b, n) in enumerate(zip(begin, size)):
                doc[b:b + n] = j
            d, i, s = self.windows(line, doc, begin, begin + size)
            good = self.candidates(line, i, s)
            seen: set[tuple[int, int]] = set()
            for j, item, start, last in self.joined(d[good], i[good], s[good]):
                if (j, item) in seen:
                    continue
                n, e = int(self.size[item]), int(self.edits[item])
                a, b = max(int(begin[j]), start - e), min(int(begin[j] + size[j]), last + n + 2 * e)
                own = self.line[self.begin[item]:self.begin[item] + n]
                if edit_distance(own, line[a:b]) <= e:
                    seen.add((j, item))
                    out[first + j].append(item)
        return out


def item_blocks(items: DataFrame, max_items: int = BLOCK_ITEMS, max_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of bounded size; each block is one pass over the documents.
    Sizes are summed before any text is collected; a block is collected when it is asked for."""
    sized = items.filter("text is not null").select("item_id", "text").withColumn(
        "size", F.greatest(F.lit(1), F.length("text") / 2))              # words are at most half the characters
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("w")).first()
    blocks = max(1, int(-(-total["n"] // (max_items // 2 or 1))), int(-(-total["w"] // (max_words // 2 or 1))))
    for k in range(blocks):                                # by hash: about half the bound each
        rows = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        del rows
        if block.ids:
            yield block
        del block                                          # before the next one is collected


def find_items(docs: DataFrame, items: DataFrame, **bounds) -> DataFrame:
    """(doc_id, k1, item_id): items that documents contain; ``k1`` is the text's hash."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 bigint, item_id {item_kind}"
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), "text")
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items, **bounds):
        shared = spark.sparkContext.broadcast(block)
        key = f"items-{uuid.uuid4().hex}"

        def run(batches, shared=shared, key=key):
            import pyarrow as pa

            ready = held(key, shared.value.prepare)
            for batch in batches:
                rows, item = [], []
                for k, m in enumerate(ready.matches(batch.column("text").to_pylist())):
                    rows += [k] * len(m)
                    item += [ready.ids[x] for x in m]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("k1").take(at), pa.array(item, ITEM_TYPES[item_kind])],
                    names=["doc_id", "k1", "item_id"])

        found = found.unionAll(stage(keyed.mapInArrow(run, schema), "leaks-pass"))
        shared.destroy()                                   # its matches are staged: nothing reads it again
        del block, shared, run
    return found.distinct()


def _item_types():
    import pyarrow as pa

    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


ITEM_TYPES = _item_types()


def contaminated(docs: DataFrame, items: DataFrame, **bounds) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted) of every row."""
    found = stage(find_items(docs, items, **bounds).groupBy(F.col("doc_id").alias("d"), F.col("k1").alias("k"))
                  .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")), "leaks")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"))
    out = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("k")), "left")
    ids = F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType))
    return out.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns kept."""
    found = stage(find_items(docs, items, **bounds).select(F.col("doc_id").alias("__d"), F.col("k1").alias("__k")).distinct(), "leaks")
    keyed = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k")), "left_anti").drop("__h")
