"""Collocations by set-oriented mining (SETM): phrases grow by joins of occurrence relations.

Texts are cut into pieces, equal pieces of a language are one row with a count, and

1. the occurrence relation R(1) holds the frequent words of every piece by position. A
   relation is nested, one row a piece: the numbers of the phrases that begin at its
   positions (-1: a rare one). It is written in buckets by piece;
2. R(k) meets itself on the piece and the adjacent position, which is the next place of the
   row, and gives the occurrences of all phrases of k + 1 words whose two parts of k words
   are frequent;
3. occurrences are counted by bucket and phrase, the counts of a phrase meet in one shuffle
   (a phrase that very many pieces hold is one row a bucket), rare phrases go, the others are
   numbered and each bucket gets the numbers of the phrases that it holds;
4. R(k + 1) is what a semi-join with these leaves of the occurrences, bucket by bucket,
   written like R(1) before the next length. Pieces without neighbours go.

A phrase is a number; a phrase of k + 1 words is the pair of its first and its last k
words, so words and counts of every cut are carried along the frequent phrases alone.

Occurrences are never shuffled or broadcast, however many phrases are frequent: what moves
is a row a bucket and phrase, and a bucket's list is never longer than its occurrences. Only
words are text, and joined with their numbers by the engine: broadcast while there are at most
``BROADCAST_PHRASES`` of them (a counted bound), shuffled beyond it.

Cases: null text has no piece, null language counts as ``und``; pieces without a word give
nothing; an empty table gives no rows; repeated rows count as often as they occur; ties in
score are told apart by count, then phrase (bytes); other columns are ignored whatever
their names. A very long piece is a long row.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import partitions, ship, small_batches
from souk.sources.staging import drop_staged, stage, staged_path

CUTS = rb"[.,;:!?\x0a-\x0d]"
UNKNOWN_LANGUAGE = "und"
#: Frequent words are broadcast up to this count (about 40 MB of words and numbers).
BROADCAST_PHRASES = 250_000
#: Rows of an Arrow batch of pieces, its bytes, and the bytes that are worked on at a time.
PIECE_ROWS = 20_000
PIECE_BYTES = 8 << 20
CHUNK_BYTES = 24 << 20
COUNT = "decimal(16,0)"


def cut_pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, words, n: pieces of every text (A-Z lowered, words joined by one space),
    counted within each Arrow batch."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
                         F.col("text").cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa

        cut = re.compile(CUTS).split
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:                                # bytes.lower and bytes.split know ASCII only
                    seen.update([(lang, b" ".join(words)) for p in cut(text.lower()) if (words := p.split())])
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
                pa.array([k[1].count(b" ") + 1 for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
                names=["lang", "piece", "words", "n"])

    out = source.mapInArrow(run, "lang string, piece binary, words int, n bigint")
    return out.withColumn("piece", F.col("piece").cast("string"))


class Relations:
    """Bucketed tables of one run under the shared checkpoint folder; dropped at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, partitions(spark)
        self.names: dict[str, str] = {}

    def bucket(self, *names: str) -> Column:
        """A bucket for the values of these columns: a number that alone is hashed into its
        bucket, so that the rows of a number are one bucket."""
        n = self.buckets
        tried = self.spark.range(int(n * (math.log(n) + 20)) + 20).select(
            F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("b"))
        found = {r["b"]: r["id"] for r in tried.groupBy("b").agg(F.min("id").alias("id")).collect()}
        keys = F.split(F.lit(",".join(str(found.get(k, k)) for k in range(n))), ",").cast("array<int>")
        return F.element_at(keys, F.pmod(F.hash(*names), F.lit(n)) + 1)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, whose rows lie in their buckets by the column p."""
        name = f"souk_setm_{label}_{uuid.uuid4().hex}"
        (df.write.bucketBy(self.buckets, "p").mode("overwrite")
         .option("path", staged_path(self.spark, f"setm-{label}")).saveAsTable(name))
        self.names[label] = name
        return self.spark.table(name)

    def drop(self, label: str) -> None:
        name = self.names.pop(label)
        drop_staged(self.spark.table(name))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def batches_of_pieces(spark: SparkSession):
    """Arrow batches of many rows while this holds: pieces are short, and bytes are bounded too."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": PIECE_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": PIECE_BYTES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def semi_join(df: DataFrame, phrases: DataFrame, on: list[str], count: int) -> DataFrame:
    """Rows of ``df`` whose key is frequent, with the phrase's number."""
    if count <= BROADCAST_PHRASES:
        return df.join(F.broadcast(phrases), on)
    return df.join(phrases.hint("shuffle_merge"), on)


# -- chunks of a relation in Arrow and numpy ------------------------------------

def chunks(batches):
    """Tables of about CHUNK_BYTES from Arrow batches, each of one bucket: (p, table)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def apart(held):
        table = pa.Table.from_batches(held).combine_chunks()
        found = pc.unique(table["p"]).to_pylist()
        for p in found:
            yield p, table if len(found) == 1 else table.filter(pc.equal(table["p"], p)).combine_chunks()

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from apart(held)
            held, size = [], 0
    if held:
        yield from apart(held)


def whole(column):
    """One array of a column of a table."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def numbers(column) -> np.ndarray:
    return whole(column).to_numpy(zero_copy_only=False)


def unnested(lists) -> tuple[np.ndarray, object]:
    """The row of every value of a list array, and the values."""
    import pyarrow.compute as pc

    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def small(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays themselves while their numbers have 31 bits, else numbers of this call."""
    if all(x.max(initial=0) < 1 << 31 for x in arrays):
        return arrays
    seen = np.unique(np.concatenate(arrays))
    return tuple(np.searchsorted(seen, x) for x in arrays)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where in it each key begins."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def pairs_of(row: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places at which a frequent phrase begins, as at the next place of the row."""
    return np.flatnonzero((g[:-1] >= 0) & (g[1:] >= 0) & (row[1:] == row[:-1]))


def word_codes(lang, words, row, langs, phrases):
    """Numbers of this call for (language of the row, word) and for (langs, phrases), and the
    languages and words behind them: number = place of the language * len(words) + place of the word."""
    import pyarrow as pa

    def coded(a, b):
        found = pa.concat_arrays([a, b]).dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return codes[:len(a)], codes[len(a):], found.dictionary

    (l1, l2, langs), (w1, w2, words) = coded(lang, langs), coded(words, phrases)
    return l1[row] * len(words) + w1, l2 * len(words) + w2, langs, words


def sums(key: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below ``size``) that occur, and the sum of ``n`` of each."""
    if size <= 4 * len(key) + 1000 and n.sum() < 1 << 53:         # exact in double precision
        f = np.bincount(key, n, size).astype(np.int64)
        return np.flatnonzero(f), f[f > 0]
    order, start = groups(key)
    return key[order[start]], np.add.reduceat(n[order], start)


def looked_up(key: np.ndarray, known: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """``g`` of each key (keys are below ``size``), -1 for one that is not known."""
    if not len(known):
        return np.full(len(key), -1, np.int64)
    if size <= 4 * len(key) + 1000:
        table = np.full(size, -1, np.int64)
        table[known] = g
        return table[key]
    order = np.argsort(known)
    known, g = known[order], g[order]
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, g[at], -1)


def numbers_within(column) -> tuple[np.ndarray, np.ndarray]:
    """The row of every number of a relation's column g, and the numbers."""
    column = whole(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    g = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(np.int64) if data else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), g


def nested(p: int, n: np.ndarray, row: np.ndarray, g: np.ndarray):
    """A part of a relation: the rows that still have neighbours."""
    import pyarrow as pa

    live = np.zeros(len(n), bool)
    live[row[pairs_of(row, g)]] = True
    keep = live[row]
    offsets = np.concatenate(([0], 8 * np.cumsum(np.bincount(row[keep], minlength=len(n))[live]))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(g[keep])])
    return pa.table({"p": pa.array(np.full(len(packed), p), pa.int32()), "n": pa.array(n[live], pa.int64()), "g": packed})


#: g holds numbers of 8 bytes: a row is moved as a whole, not number by number.
RELATION = "p int, n bigint, g binary"


def together(parts: list):
    import pyarrow as pa

    empty = pa.schema([("p", pa.int32()), ("n", pa.int64()), ("g", pa.binary())]).empty_table()
    return pa.concat_tables([empty, *parts])


# -- the steps ------------------------------------------------------------------

def counted_words(pieces: DataFrame) -> DataFrame:
    """(p, lang, phrase, f): words of every bucket, counted in each chunk."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for p, table in chunks(batches):
            row, words = unnested(pc.split_pattern(whole(table["piece"]), " "))
            lang = whole(table["lang"])
            key, _, langs, words = word_codes(lang, words, row, lang.slice(0, 0), words.slice(0, 0))
            key, f = sums(key, numbers(table["n"])[row], len(langs) * len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), p), pa.int32()), langs.take(pa.array(key // len(words))),
                 words.take(pa.array(key % len(words))), pa.array(f, pa.int64())],
                names=["p", "lang", "phrase", "f"])

    return pieces.select("p", "lang", "piece", "n").mapInArrow(run, "p int, lang string, phrase string, f bigint")


def counted_pairs(r: DataFrame) -> DataFrame:
    """(p, g1, g2, f): phrases at adjacent positions in every bucket, counted in each chunk."""
    def run(batches):
        import pyarrow as pa

        for p, table in chunks(batches):
            row, g = numbers_within(table["g"])
            at = pairs_of(row, g)
            if not len(at):
                continue
            g1, g2 = g[at], g[at + 1]
            x, y = small(g1, g2)
            order, start = groups((x << 32) | y)
            first = order[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), p), pa.int32()), pa.array(g1[first]), pa.array(g2[first]),
                 pa.array(np.add.reduceat(numbers(table["n"])[row[at[order]]], start), pa.int64())],
                names=["p", "g1", "g2", "f"])

    return r.select("p", "n", "g").mapInArrow(run, "p int, g1 bigint, g2 bigint, f bigint")


def place(k: np.ndarray, width: int) -> np.ndarray:
    """Numbers of this task's phrases: no other of the ``width`` tasks gives them."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    if task >= width:
        raise ValueError(f"task {task} of {width}")
    return k * width + task


def numbered_words(counted: DataFrame, width: int) -> DataFrame:
    """(lang, phrase, f, g): frequent words with their numbers."""
    def run(batches):
        import pyarrow as pa

        n = 0
        for batch in batches:
            g = place(np.arange(n, n + batch.num_rows), width)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g, pa.int64())], names=["lang", "phrase", "f", "g"])

    return (counted.select("lang", "phrase", "f").repartition(width, "lang", "phrase")
            .mapInArrow(run, "lang string, phrase string, f bigint, g bigint"))


def numbered_pairs(counted: DataFrame, min_count: int, width: int) -> DataFrame:
    """(p, g1, g2, f, g, first): the frequent pairs, numbered, in every bucket that holds them;
    f is the sum over all buckets, ``first`` marks one row of each pair."""
    def run(batches):
        import pyarrow as pa

        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        p, g1, g2, n = (numbers(table[c]) for c in ("p", "g1", "g2", "f"))
        x, y = small(g1, g2)
        order, start = groups((x << 32) | y)
        f = np.add.reduceat(n[order], start)
        often = f >= min_count
        g = place(np.cumsum(often) - 1, width)
        size = np.diff(np.append(start, len(order)))
        keep = np.repeat(often, size)
        first = np.zeros(len(order), bool)
        first[start] = True
        at = order[keep]
        out = pa.table({"p": pa.array(p[at], pa.int32()), "g1": g1[at], "g2": g2[at], "f": np.repeat(f, size)[keep],
                        "g": np.repeat(g, size)[keep], "first": first[keep]})
        yield from out.to_batches(max_chunksize=100_000)

    return counted.repartition(width, "g1", "g2").mapInArrow(
        run, "p int, g1 bigint, g2 bigint, f bigint, g bigint, first boolean")


def first_relation(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """R(1) from the pieces and the numbers of the words that each bucket holds."""
    def run(left, right):
        import pyarrow.compute as pc

        langs, phrases, g = whole(right["lang"]), whole(right["phrase"]), numbers(right["g"])
        parts = []
        for p, table in chunks(left.to_batches()):
            row, words = unnested(pc.split_pattern(whole(table["piece"]), " "))
            key, known, *all_of = word_codes(whole(table["lang"]), words, row, langs, phrases)
            size = len(all_of[0]) * len(all_of[1])
            parts.append(nested(p, numbers(table["n"]), row, looked_up(key, known, g, size)))
        return together(parts)

    return (pieces.select("p", "lang", "piece", "n").groupBy("p")
            .cogroup(places.select("p", "lang", "phrase", "g").groupBy("p")).applyInArrow(run, RELATION))


def next_relation(r: DataFrame, places: DataFrame) -> DataFrame:
    """R(k + 1) from R(k) and the numbers of the pairs that each bucket holds."""
    def run(left, right):
        g1, g2, number = (numbers(right[c]) for c in ("g1", "g2", "g"))
        parts = []
        for p, table in chunks(left.to_batches()):
            row, g = numbers_within(table["g"])
            at = pairs_of(row, g)
            x, y, x2, y2 = small(g[at], g[at + 1], g1, g2)
            out = np.full(len(g), -1, np.int64)
            out[at] = looked_up((x << 32) | y, (x2 << 32) | y2, number, 1 << 63)
            parts.append(nested(p, numbers(table["n"]), row, out))
        return together(parts)

    return (r.select("p", "n", "g").groupBy("p")
            .cogroup(places.select("p", "g1", "g2", "g").groupBy("p")).applyInArrow(run, RELATION))


def phrase_counts(docs: DataFrame, max_words: int, min_count: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to ``max_words`` words, one frame each (lang, phrase, f, g, g1,
    g2, last: the last word, heads and tails: counts of the two parts of every cut), and the
    number of words per language."""
    spark = docs.sparkSession
    rel = Relations(spark)
    width = rel.buckets
    pieces = (cut_pieces(docs).withColumn("p", rel.bucket("lang", "piece")).repartition(rel.buckets, "p")
              .groupBy("p", "lang", "piece", "words").agg(F.sum("n").alias("n")))
    pieces = rel.write(pieces, "pieces")
    totals = stage(pieces.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).cast(COUNT).alias("total")), "setm-totals")

    with batches_of_pieces(spark):
        held = stage(counted_words(pieces), "setm-words")
        counted = held.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
        words = stage(numbered_words(counted, width), "setm-c1")
        none = F.array().cast("array<bigint>")
        phrases = [words.select("lang", "phrase", "f", "g", F.col("phrase").alias("last"), none.alias("heads"), none.alias("tails"))]
        r = rel.write(first_relation(pieces, semi_join(held, words.select("lang", "phrase", "g"), ["lang", "phrase"], words.count())), "r1")
        drop_staged(held)
        rel.drop("pieces")

        for k in range(2, max_words + 1):
            places = stage(numbered_pairs(counted_pairs(r), min_count, width), f"setm-c{k}")
            pairs = places.filter("first").select("g1", "g2", "f", "g")
            phrases.append(stage(grown(pairs, phrases[-1]), f"setm-phrases{k}"))
            if k < max_words:
                r = rel.write(next_relation(r, places), f"r{k}")
            drop_staged(places)
            rel.drop(f"r{k - 1}")
    return phrases, totals


def grown(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Words and counts of every cut of the frequent pairs, from those of their two parts."""
    x = shorter.select(F.col("g").alias("g1"), "lang", F.col("phrase").alias("p1"), F.col("f").alias("f1"), "heads")
    y = shorter.select(F.col("g").alias("g2"), "last", F.col("f").alias("f2"), "tails")
    return pairs.join(x, "g1").join(y, "g2").select(
        "lang", F.concat_ws(" ", "p1", "last").alias("phrase"), "f", "g", "g1", "g2", "last",
        F.concat("heads", F.array("f1")).alias("heads"), F.concat(F.array("f2"), "tails").alias("tails"))


def closed(phrases: DataFrame, longer: DataFrame | None, percent: int) -> DataFrame:
    """Phrases that no phrase with one word more holds at ``percent`` of their count. (One
    that a still longer phrase holds so often is held by a part of that one as well.)"""
    if longer is None:
        return phrases
    holders = (longer.select(F.col("g1").alias("g"), F.col("f").alias("held"))
               .unionAll(longer.select(F.col("g2").alias("g"), F.col("f").alias("held")))
               .groupBy("g").agg(F.max("held").alias("held")))
    return (phrases.join(holders, "g", "left")
            .filter(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("f"))).drop("held"))


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, top: int = 2000,
                 closed_percent: int = 100) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of every language: lang, rank, phrase,
    a (count), l and r (counts of the two parts of the lowest-scoring cut), n (words of the
    language) and score = floor(1000 a n / (l r)). Products are decimals, so exact."""
    phrases, totals = phrase_counts(docs, max_words, min_count)
    found = None
    for k, longer in zip(range(1, max_words), [*phrases[2:], None], strict=True):
        part = closed(phrases[k], longer, closed_percent).select("lang", "phrase", "f", "g", "heads", "tails")
        found = part if found is None else found.unionByName(part)
    gain = F.lit(1000).cast("decimal(4,0)") * (F.col("f").cast(COUNT) * F.col("total"))
    found = found.join(totals, "lang").withColumn("gain", gain.cast("decimal(38,0)"))
    # IntegralDivide of decimals is exact and gives a long; the least (score, cut) counts.
    found = found.withColumn("cut", F.expr(
        "array_min(transform(heads, (l, i) -> struct("
        f"gain div (cast(l as {COUNT}) * cast(tails[i] as {COUNT})) as score, i as i, l as l, tails[i] as r)))"))
    found = found.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                         F.col("total").cast("bigint").alias("n"), F.col("cut.score").alias("score"),
                         F.pmod(F.hash("g"), F.lit(partitions(docs.sparkSession))).alias("part"))
    # A language may hold most phrases: the best of each part first, then the best of those.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    in_part = Window.partitionBy("lang", "part").orderBy(*best)
    whole = Window.partitionBy("lang").orderBy(*best)
    found = found.withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= top)
    out = found.withColumn("rank", F.row_number().over(whole).cast("bigint")).filter(F.col("rank") <= top)
    out = stage(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "setm-result")
    drop_staged(*phrases, totals)
    return out


#: DuckDB SQL of the query, from all word sequences of the texts.
SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece WHERE len(w) > 0),
gram AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM spot),
f AS MATERIALIZED (SELECT lang || '/' || array_to_string(w[i:i + k - 1], ' ') AS key, lang, k, count(*) AS a
      FROM gram GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k AS size, a, string_split(substr(key, length(lang) + 2), ' ') AS words
      FROM f WHERE k >= 2 AND a >= 100),
cuts AS MATERIALIZED (SELECT lang, size, a, words, k, lang || '/' || array_to_string(words[1:k], ' ') AS head,
      lang || '/' || array_to_string(words[k + 1:], ' ') AS tail
      FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
left_part AS MATERIALIZED (SELECT cuts.*, f.a AS l FROM cuts JOIN f ON f.key = head),
both_parts AS MATERIALIZED (SELECT left_part.*, f.a AS r FROM left_part JOIN f ON f.key = tail),
scored AS (SELECT both_parts.*, n, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM both_parts JOIN n USING (lang)),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_part AS (SELECT lang, words[s:s + m - 1] AS words, a
      FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM cand))),
held AS (SELECT lang, words, max(a) AS longest_a FROM inner_part GROUP BY lang, words),
kept AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score
      FROM lowest LEFT JOIN held USING (lang, words) WHERE longest_a IS NULL OR 100 * longest_a < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
