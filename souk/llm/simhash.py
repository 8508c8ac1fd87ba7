"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints: words of the lower-cased text (ASCII white space separates them),
shingles of three words, each hashed by XXH64; a bit is set if more than half
of the shingle hashes have it set.

Search for fingerprints that differ in at most ``k`` bits: the 64 bits are cut
into 32 segments of 2 bits and a fingerprint is mapped to the vector of its
segments' bit counts. A changed bit changes one count by one, so the Manhattan
distance of two vectors never exceeds the number of differing bits: it is a
lower bound. The range join runs on a grid whose cells are whole count vectors
of one half (16 segments): at most ``k`` changes in two halves leave one half
with at most ``k // 2``, so each fingerprint enters its own cell and asks the
cells within that Manhattan distance, once per half. Pairs that meet are cut by
the Manhattan bound over all segments, then verified by counting the bits that
differ. Only distinct fingerprints take part, so copies never meet as pairs.

Cases: null text has no word; no word gives fingerprint zero, which links like
any other; fewer words than a shingle give one shingle of all words; equal
doc_ids are one node (each row gets its fingerprint, and the node is reachable
from each of them); null doc_ids are reported with a null component unless
reached through another row's id; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship, small_batches
from souk.llm.components import components
from souk.sources.staging import stage

SEGMENTS = 32
SHINGLE = 3
MAX_BITS = 3


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of one text (unsigned)."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []   # ASCII case and white space only
    if not words:
        return 0
    hashing = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        hashes = np.array([hashing(b" ".join(words), 42)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - words_per_shingle + 1
        hashes = np.fromiter((hashing(joined[a:b], 42) for a, b in
                              zip(starts[:n].tolist(), (ends[words_per_shingle - 1:] - 1).tolist())),
                             np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):             # bounded memory for very long texts
        block = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.nonzero(2 * ones > len(hashes))[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint (as a signed long) of every row."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()],
                           dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _half_counts(fp: Column, half: int) -> Column:
    """The 16 two-bit segment counts of one half, two bits each, in one int."""
    x = F.shiftright(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    odd = F.lit(0x55555555)
    return x.bitwiseAND(odd) + F.shiftright(x, 1).bitwiseAND(odd)


def _steps(counts: Column, reach: int) -> Column:
    """All count vectors within Manhattan distance ``reach`` (as packed ints; steps
    that leave 0..2 fall on no stored cell or are dropped)."""
    def moved(deltas: tuple[tuple[int, int], ...]) -> Column:
        ok, value = F.lit(True), counts
        for seg, d in deltas:
            c = F.shiftright(counts, 2 * seg).bitwiseAND(F.lit(3))
            ok = ok & (c + F.lit(d)).between(0, 2)
            value = value + F.lit(d << (2 * seg))
        return F.when(ok, value)

    moves: list[tuple] = [()]
    for size in range(1, reach + 1):
        for segs in combinations(range(SEGMENTS // 2), size):
            for ds in product(*[[d for d in range(-reach, reach + 1) if d] for _ in segs]):
                if sum(map(abs, ds)) <= reach:
                    moves.append(tuple(zip(segs, ds)))
    return F.filter(F.array(*[moved(m) for m in moves]), lambda v: v.isNotNull())


def near_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b, bits): pairs of distinct fingerprints, a < b, that differ in at
    most ``max_bits`` bits. ``fps`` has a column fp without repetition."""
    reach = max_bits // 2
    cols = ["fp", *(f"c{h}" for h in (0, 1))]
    vec = fps.select("fp", *[_half_counts(F.col("fp"), h).alias(f"c{h}") for h in (0, 1)])
    found = []
    for half in (0, 1):
        cells = vec.select(*[F.col(c).alias(f"{c}_a") for c in cols], F.col(f"c{half}").alias("cell"))
        asks = vec.select(*[F.col(c).alias(f"{c}_b") for c in cols],
                          F.explode(_steps(F.col(f"c{half}"), reach)).alias("cell"))
        # The engine takes the asks for no larger than the fingerprints before the explode (each
        # has up to 33 asks at 3 bits) and would broadcast them: the hint keeps both sides shuffled.
        found.append(cells.hint("merge").join(asks.hint("merge"),
                                              (cells["cell"] == asks["cell"]) & (cells["fp_a"] < asks["fp_b"])))
    met = reduce(DataFrame.unionAll, found)
    apart = F.lit(0)
    for h in (0, 1):                            # Manhattan distance over all segments, packed
        for seg in range(SEGMENTS // 2):
            at = 2 * seg
            apart = apart + F.abs(F.shiftright(F.col(f"c{h}_a"), at).bitwiseAND(F.lit(3))
                                  - F.shiftright(F.col(f"c{h}_b"), at).bitwiseAND(F.lit(3)))
    bits = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    return (met.filter(apart <= max_bits)
            .select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), bits.alias("bits"))
            .filter(F.col("bits") <= max_bits).distinct())


def simhash_groups(docs: DataFrame, words_per_shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, n_links, component_id): every row with its fingerprint, the
    number of other distinct fingerprints linked directly, and the least doc_id
    reachable over links (copies included)."""
    base = stage(fingerprints(docs, words_per_shingle), "simhash-fp")
    # One row per distinct fingerprint; hot fingerprints are combined before the shuffle.
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    links = stage(near_fingerprints(nodes.select("fp"), max_bits), "simhash-links")
    # A doc_id on several rows joins their fingerprints as well: it is one node.
    shared = (base.filter("doc_id is not null").groupBy("doc_id")
              .agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count(F.lit(1)).alias("n")))
    bridges = (base.join(shared.filter("a != z").select("doc_id", "a"), "doc_id").filter("fp != a")
               .select(F.col("a").alias("src"), F.col("fp").alias("dst")))
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(bridges)
    comp = components(edges)
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    degree = (links.select(F.col("a").alias("fp")).unionAll(links.select(F.col("b").alias("fp")))
              .groupBy("fp").agg(F.count(F.lit(1)).alias("n_links")))
    classes = (named.join(least, "root").join(degree, "fp", "left")
               .select("fp", "component_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    # Staged, so that both sides of the last join are shuffled for it alone and a
    # fingerprint that very many rows share can be split over tasks.
    return base.join(stage(classes, "simhash-classes"), "fp").select("doc_id", "fp", "n_links", "component_id")
