"""Exact removal of long repeated byte strings by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that starts at any other place
of the corpus too is removed; strings are judged on the input, and a string
never crosses documents.

Parsing. A rolling hash of ``TRIGGER`` bytes is taken at every position; the
trigger of a string of ``LENGTH`` bytes is its least-hashed position (leftmost
of equals). Consecutive strings with the same trigger make a *phrase*: the
bytes they cover, which overlap the next phrase by ``LENGTH - 1`` bytes. Equal
strings have equal triggers at equal offsets, so every string lies whole in
one phrase and can only repeat in phrases with the same trigger bytes.

Combining. The parse (one row per phrase occurrence: trigger hash, phrase hash,
place) is counted first: a trigger seen once cannot repeat and is dropped; a
phrase seen twice repeats whole. What remains are distinct phrases that share
trigger bytes -- the dictionary. Their suffixes are ordered by two suffix
arrays around the trigger: one over the reversed left parts (which strings share
how many bytes before the trigger) and one over the right parts (how many
after). The corpus order of the strings at offset ``s`` is the pair of ranks
(class of the last ``s`` bytes on the left, class of the first ``LENGTH - s`` on
the right); neighbours that are equal in both repeat. Only dictionary phrases
are ever compared, so very repetitive text costs little.

Skew. Counting is map-side combined; joins on trigger hashes shuffle both sides
for themselves, so a trigger that very many rows share is split. A trigger
with more than ``GROUP_LIMIT`` distinct phrases is not given to one task: the
strings of its phrases are hashed (128 bits) and counted by a combined
aggregate, which is exact as well.

Texts are read by two jobs: the parse, and one join that fetches the texts
having any shared trigger (staged, usually a small part). Phrase hashes have 64
bits and are compared only inside one 64-bit trigger hash.

Cases: null text counts as empty; texts shorter than ``LENGTH`` never change;
repeated rows are repeats of each other, whatever their ids; null ids are
matched as null; an empty table gives an empty result; extra columns are
ignored (or carried by :func:`remove_repeats`).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship, small_batches
from souk.sources.staging import drop_staged, stage

LENGTH = 200
TRIGGER = 64
GROUP_LIMIT = 50_000
BLOCK = 1 << 18              # bytes parsed at a time; a longer text is parsed in blocks
COMPARE_ROWS = 10_000        # dictionary phrases compared at a time

_RNG = np.random.default_rng(71)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Rolling hashes of all substrings of a byte buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[data] * up[:-1], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size])


def _parse_block(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, trigger: int):
    """Phrases of a buffer whose strings start in [first[k], last[k]) for each
    segment k: arrays segment, trigger hash, phrase hash, t, lo, hi."""
    h = Hashes(data)
    grams = h.all(trigger)
    n = len(grams)
    best = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    width, want = 1, length - trigger + 1
    while 2 * width <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = np.minimum(best[:len(best) - (want - width)], best[want - width:])
    at = (best & np.uint64((1 << 24) - 1)).astype(np.int64)       # trigger of the string at each start
    cut = np.zeros(len(at) + 1, bool)
    cut[1:-1] = at[1:] != at[:-1]
    inside = np.zeros(len(at) + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside)[:-1] > 0
    cut[first] = True
    cut[last] = True
    starts = np.nonzero(cut[:-1] & inside)[0]
    ends = np.nonzero(cut)[0]
    stops = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
    hi = stops - 1
    t = at[starts]
    seg = np.searchsorted(first, starts, side="right") - 1
    with np.errstate(over="ignore"):
        phrase = _mix(h.of(starts, hi + length) + (t - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                      + (hi - starts).astype(np.uint64))
    return seg, grams[t], phrase, t, starts, hi


def parse(texts: list[bytes], length: int = LENGTH, trigger: int = TRIGGER):
    """Phrases of texts: arrays text index, trigger hash, phrase hash, trigger
    place t, first and last string start (lo, hi), places within the text."""
    out = []
    pending: list[tuple[int, int, bytes]] = []        # text, offset, bytes
    size = 0

    def flush():
        nonlocal pending, size
        if pending:
            data = np.frombuffer(b"".join(p[2] for p in pending), np.uint8)
            begin = np.cumsum([0] + [len(p[2]) for p in pending])
            first, last = begin[:-1], begin[1:] - length + 1
            seg, g, c, t, lo, hi = _parse_block(data, first, last, length, trigger)
            text = np.array([p[0] for p in pending])[seg]
            shift = (np.array([p[1] for p in pending]) - first)[seg]
            out.append((text, g, c, t + shift, lo + shift, hi + shift))
        pending, size = [], 0

    for k, b in enumerate(texts):
        for start in range(0, max(0, len(b) - length + 1), BLOCK):
            part = b[start:start + BLOCK + length - 1]
            if size + len(part) > 2 * BLOCK:
                flush()
            pending.append((k, start, part))
            size += len(part)
    flush()
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


# -- comparing dictionary phrases ---------------------------------------------

def _padded(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


def _suffix_order(group: np.ndarray, content: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, content) and the common length with the row before
    (-1 where the group changes)."""
    width = -(-content.shape[1] // 8) * 8
    wide = np.zeros((len(content), width), np.uint8)
    wide[:, :content.shape[1]] = content
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort([sizes, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group])
    a, b = content[order[1:]], content[order[:-1]]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), content.shape[1])
    common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def repeated_offsets(group: np.ndarray, rel: np.ndarray, phrases: list[bytes], length: int = LENGTH,
                     trigger: int = TRIGGER) -> np.ndarray:
    """For each phrase (trigger at ``rel``) and offset ``s``: does the string that
    starts ``s`` bytes before the trigger occur in another phrase of the group?"""
    n, reach = len(phrases), length - trigger
    left = [p[max(0, r - reach):r][::-1] for p, r in zip(phrases, rel)]
    right = [p[r:r + length] for p, r in zip(phrases, rel)]
    left_size, right_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    lo, lc = _suffix_order(group, _padded(left, reach), left_size)
    ro, rc = _suffix_order(group, _padded(right, length), right_size)
    lrank, rrank = np.empty(n, np.int64), np.empty(n, np.int64)
    out = np.zeros((n, reach + 1), bool)
    for s in range(reach + 1):
        rows = np.nonzero((left_size >= s) & (right_size >= length - s))[0]
        if len(rows) < 2:
            continue
        lrank[lo] = np.cumsum(lc < s)
        rrank[ro] = np.cumsum(rc < length - s)
        pair = lrank[rows] * (n + 1) + rrank[rows]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        hit = np.zeros(len(rows), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        out[rows[hit], s] = True
    return out


def _runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans relative to the trigger from the offsets that repeat."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [(-int(b - 1), -int(a) + length) for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# -- Spark --------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k1", F.xxhash64(F.coalesce("text", F.lit(""))))


def _parse_table(keyed: DataFrame, length: int, trigger: int) -> DataFrame:
    """One row per phrase: ord (number of the text's row), g, c and ``place`` (t, t - lo
    and t - hi in one long). The first phrase of a row also has its doc_id and k1,
    so that the shuffles that follow carry four longs and no keys."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            text, g, c, t, lo, hi = parse(texts, length, trigger)
            first = np.ones(len(text), bool)
            first[1:] = text[1:] != text[:-1]
            rows = pa.array(text, mask=~first)
            place = (t << 16) | ((t - lo) << 8) | (t - hi)
            yield pa.RecordBatch.from_arrays(
                [pa.array(text + at, pa.int64()), batch.column("doc_id").take(rows), batch.column("k1").take(rows),
                 *(pa.array(x.view(np.int64), pa.int64()) for x in (g, c, place.astype(np.int64)))],
                names=["ord", "doc_id", "k1", "g", "c", "place"])
            at += len(texts)

    return keyed.select("doc_id", "k1", "text").mapInArrow(
        run, f"ord bigint, doc_id {kind}, k1 bigint, g bigint, c bigint, place bigint")


# Parts of ``place``.
_T = "shiftright(place, 16)"
_LO = "shiftright(place, 16) - (shiftright(place, 8) & 255)"
_HI = "shiftright(place, 16) - (place & 255)"


def _same_key(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k1"] == b["k1"])


def _cut_phrases(asked: DataFrame, length: int) -> DataFrame:
    """(g, c, m, rel, phrase) from (text, asks: array of g, c, m, t, lo, hi)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for text, asks in zip(batch.column("text").to_pylist(), batch.column("asks").to_pylist()):
                data = text.encode()
                for x in asks:
                    for k, v in enumerate((x["g"], x["c"], x["m"], x["t"] - x["lo"], data[x["lo"]:x["hi"] + length])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kind) for v, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["g", "c", "m", "rel", "phrase"])

    return asked.select("text", "asks").mapInArrow(run, "g bigint, c bigint, m bigint, rel int, phrase binary")


def _compare_sorted(phrases: DataFrame, length: int, trigger: int) -> DataFrame:
    """(g, c, a, b): repeated spans relative to the trigger. Groups arrive whole
    and sorted; whole groups are gathered into blocks of about COMPARE_ROWS."""
    def block(rows):
        seen, g, c, rel, data = set(), [], [], [], []
        for x in rows:
            if x[:2] not in seen:                       # repeated input rows give a phrase twice
                seen.add(x[:2])
                g.append(x[0])
                c.append(x[1])
                rel.append(x[2])
                data.append(x[3])
        group = np.unique(np.array(g, np.int64), return_inverse=True)[1]
        flags = repeated_offsets(group, np.array(rel), data, length, trigger)
        return [(g[k], c[k], a, b) for k in np.nonzero(flags.any(axis=1))[0] for a, b in _runs(flags[k], length)]

    def run(batches):
        import pyarrow as pa

        def table(rows):
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                names=["g", "c", "a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(batch.column(n).to_pylist() for n in ("g", "c", "rel", "phrase"))):
                if len(held) >= COMPARE_ROWS and x[0] != held[-1][0]:
                    yield table(block(held))
                    held = []
                held.append(x)
        if held:
            yield table(block(held))

    return (phrases.select("g", "c", "rel", "phrase").repartition("g").sortWithinPartitions("g")
            .mapInArrow(run, "g bigint, c bigint, a int, b int"))


def _compare_hashed(phrases: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for one task: every string of their distinct
    phrases is hashed and counted by a combined aggregate."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for g, c, rel, p in zip(*(batch.column(n).to_pylist() for n in ("g", "c", "rel", "phrase"))):
                n = len(p) - length + 1
                d = [hashlib.blake2b(p[k:k + length], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * n, pa.int64()), pa.array([c] * n, pa.int64()),
                     pa.array([rel - k for k in range(n)], pa.int32()), pa.array(d, pa.binary())],
                    names=["g", "c", "s", "d"])

    strings = stage(phrases.dropDuplicates(["g", "c"]).select("g", "c", "rel", "phrase")
                    .mapInArrow(run, "g bigint, c bigint, s int, d binary"), "repeats-strings")
    twice = stage(strings.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n"),
                  "repeats-strings2")
    return strings.join(twice, ["s", "d"]).select(
        "g", "c", (-F.col("s")).alias("a"), (F.lit(length) - F.col("s")).alias("b"))


def find_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER,
                 group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """``spans`` (doc_id, k1, spans: array of start, stop) of every text that has a
    repeated string, and ``texts`` (doc_id, k1, text): the rows of these and of
    some other texts. ``k1`` is the text's 64-bit hash."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    keyed = _keyed(docs.select("doc_id", "text"))
    if length - trigger > 255:
        raise ValueError("a trigger may be at most 255 bytes shorter than the string")
    parsed = stage(_parse_table(keyed, length, trigger), "repeats-parse")
    seen = parsed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("g")
    # Staged, so that the joins below shuffle both sides for themselves.
    shared = stage(parsed.select("ord", "g", "c", "place").join(stage(seen, "repeats-seen"), "g"), "repeats-shared")
    phrases = stage(shared.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "place")).alias("at")),
                    "repeats-phrases")
    groups = stage(phrases.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m >= 2"), "repeats-groups")
    dictionary = phrases.join(groups, "g").select("g", "c", "m", "at.*")

    rows = parsed.filter("k1 is not null").select("ord", "doc_id", "k1")
    owners = stage(rows.join(shared.select("ord").distinct(), "ord"), "repeats-owners")
    drop_staged(parsed)
    asked = dictionary.groupBy("ord").agg(F.collect_list(F.struct(
        "g", "c", "m", F.expr(_T).alias("t"), F.expr(_LO).alias("lo"), F.expr(_HI).alias("hi"))).alias("asks"))
    # One row per text to fetch, with the phrases to cut from it (as many as it has, at most).
    keys = stage(owners.join(asked, "ord", "left").groupBy("doc_id", "k1")
                 .agg(F.flatten(F.collect_list("asks")).alias("asks")), "repeats-keys")
    fetched = keyed.join(keys.withColumnsRenamed({"doc_id": "doc_id2", "k1": "k2"}),
                         F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("k1") == F.col("k2")))
    texts = stage(fetched.select("doc_id", "k1", "text", "asks"), "repeats-texts")
    cut = stage(_cut_phrases(texts.filter(F.size("asks") > 0), length), "repeats-cut")
    found = _compare_sorted(cut.filter(F.col("m") <= group_limit), length, trigger)
    if not groups.filter(F.col("m") > group_limit).isEmpty():
        found = found.unionAll(_compare_hashed(cut.filter(F.col("m") > group_limit), length))
    partial = found.groupBy("g", "c").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    once = phrases.filter("n = 1").select("g", "c").join(partial, ["g", "c"])
    decided = stage(phrases.filter("n >= 2").select("g", "c", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
                    .unionAll(once), "repeats-decided")
    hits = shared.join(decided, ["g", "c"])
    whole = F.array(F.struct(F.expr(_LO).alias("start"), (F.expr(_HI) + length).alias("stop")))
    moved = F.transform("runs", lambda x: F.struct((F.expr(_T) + x["a"]).alias("start"), (F.expr(_T) + x["b"]).alias("stop")))
    # Spans of one text: as many as its phrases at most.
    per_row = (hits.select("ord", F.coalesce(moved, whole).alias("spans"))
               .groupBy("ord").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    spans = stage(per_row.join(owners, "ord").groupBy("doc_id", "k1").agg(F.min(F.struct("ord", "spans")).alias("x"))
                  .select("doc_id", "k1", "x.spans"), "repeats-spans")
    drop_staged(cut, phrases, groups, shared, keys, owners, decided)
    return spans, texts.drop("asks")


def repeat_report(docs: DataFrame, length: int = LENGTH, **kw) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spans, texts = find_repeats(docs, length, **kw)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, spans_of in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                cuts = merged([(x["start"], x["stop"]) for x in spans_of])
                out.append((len(data), sum(b - a for a, b in cuts), len(cuts), kept(data, cuts)))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:3]),
                 pa.array([hashlib.sha256(x).hexdigest() for x in cols[3]], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    changed = texts.join(spans, _same_key(texts, spans)).select(texts["doc_id"], "text", "spans").mapInArrow(run, schema)
    data = F.coalesce("text", F.lit("")).cast("binary")
    narrow = _keyed(docs.select("doc_id", "text")).select(
        "doc_id", "k1", F.octet_length(data).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"))
    same = narrow.join(spans.select(F.col("doc_id").alias("d2"), F.col("k1").alias("k2")),
                       F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("k1") == F.col("k2")), "left_anti").drop("k1")
    return changed.unionAll(same)


def kept(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cuts:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, **kw) -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text`` (a character that is
    cut through goes whole); all columns are kept."""
    spans, _ = find_repeats(docs, length, **kw)

    @F.pandas_udf("string")
    def without(text, cuts):
        import pandas as pd

        return pd.Series([t if s is None else
                          kept(t.encode(), merged([(x["start"], x["stop"]) for x in s])).decode("utf-8", "ignore")
                          for t, s in zip(text, cuts)], dtype=object)

    key = spans.select(F.col("doc_id").alias("__d"), F.col("k1").alias("__k"), F.col("spans").alias("__s"))
    joined = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        key, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k")), "left")
    return joined.select(*[without("text", "__s").alias(c) if c == "text" else F.col(c) for c in docs.columns])
