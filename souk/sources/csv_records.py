"""Parallel import of CSV text whose quoted fields hold line ends.

The engine's own multi-line mode reads a whole file in one task, because a line end
ends a record only outside quotes. Inside or outside is the parity of the quotes before
it, and parities add up over byte ranges:

1. one scan counts the quotes of every split of every file (combined map-side, one row a
   split); a prefix sum of the parities per file says which splits begin inside quotes;
2. a second scan walks the lines of each split from that state. A line that begins and
   ends outside quotes is a record; other lines are joined to the record they belong to;
3. a record that crosses a split leaves a part in each: splits that begin or end inside
   quotes are read once more, and their parts are put together per record.

Records are then parsed by the engine (``from_csv``) with the declared schema. A record
that does not fit it is kept as text, so that one bad row neither ends the load nor
vanishes. Result and rejects are written once under the shared checkpoint folder.

Quotes must be paired, as doubled quotes inside quoted fields are. Empty lines are
skipped; the first record of every file is its header. Splits that begin inside quotes are
broadcast while there are at most ``BROADCAST_SPLITS``; beyond it lines meet them by a
shuffle and are sorted again. An empty folder or file gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.sources.staging import drop_staged, stage

BAD = "_corrupt_record"
PARSE_OPTIONS = {
    "quote": '"',
    "escape": '"',                # doubled quotes inside quoted fields
    "multiLine": "true",          # keep line ends inside quotes as they are
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": BAD,
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
}
#: Splits beginning inside quotes are sent to all tasks up to this count (about 100 bytes each).
BROADCAST_SPLITS = 50_000
PARTS = "file string, split bigint, part string, closed boolean, first boolean, record string"


@dataclass(frozen=True)
class CsvImport:
    """Typed rows, and the records that do not fit the schema (file, record)."""
    rows: DataFrame
    rejects: DataFrame


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """All scans within cut the files alike, whatever executors come and go."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte) and value of every line, in the order of the file."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def split_states(lines: DataFrame) -> DataFrame:
    """Per split: does it begin, does it end inside quotes? One row a split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"))
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("odd").over(upto) % 2
    return counts.select("file", "split", (((end - F.col("odd")) % 2) != 0).alias("begins_inside"), (end != 0).alias("ends_inside"))


def with_state(lines: DataFrame, inside: DataFrame, few: bool) -> DataFrame:
    """Lines with the state of their split; ``inside`` lists the splits that begin inside quotes."""
    marks = inside.select("file", "split", F.lit(True).alias("inside"))
    if few:
        out = lines.join(F.broadcast(marks), ["file", "split"], "left")
    else:
        numbered = lines.withColumn("__at", F.monotonically_increasing_id())
        out = (numbered.join(marks.hint("shuffle_merge"), ["file", "split"], "left")
               .repartition("file", "split").sortWithinPartitions("file", "split", "__at"))
    return out.select("file", "split", F.coalesce("inside", F.lit(False)).alias("inside"), "value")


def record_parts(lines: DataFrame) -> DataFrame:
    """Whole records, and parts of records that cross a split: the ``tail`` of a split holds
    the begin of a record, its ``head`` goes on with one of an earlier split (``closed``
    when the record ends there). ``first`` marks the first record of a file."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # The unfinished record of the split ``here``: its lines so far, how it began, and
        # whether it is (or the next one will be) the first of its file.
        here, pending, begun, first, open_ = None, [], "tail", False, False

        def rows(file, split, part, closed, firsts, records):
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(split, pa.int64()), n),
                 pa.repeat(pa.scalar(part, pa.string()), n), pa.repeat(pa.scalar(closed, pa.bool_()), n),
                 pa.array(firsts, pa.bool_()), pa.array(records, pa.string()) if isinstance(records, list) else records],
                names=["file", "split", "part", "closed", "first", "record"])

        def flush():
            """The unfinished record of the split that ends."""
            if pending:
                yield rows(*here, begun, False, [first], ["\n".join(pending)])
                pending.clear()

        def joined(values, starts):
            """Lines from each start up to the next, put together."""
            return pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), values), "\n")

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("value").cast(pa.string())
            names = batch.column("file").dictionary_encode()
            splits = batch.column("split").to_numpy(zero_copy_only=False)
            odds = (pc.count_substring(texts, '"').to_numpy(zero_copy_only=False) & 1).astype(bool)
            codes = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(splits) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                key = (names.dictionary[int(codes[lo])].as_py(), int(splits[lo]))
                if key != here:
                    yield from flush()
                    here, first, open_ = key, key[1] == 0, batch.column("inside")[lo].as_py()
                    begun = "head" if open_ else "tail"
                values, odd = texts.slice(lo, hi - lo), odds[lo:hi]
                after = np.logical_xor.accumulate(np.concatenate([[open_], odd]))
                starts = np.flatnonzero(~after[:-1])               # a line that begins outside quotes begins a record
                open_ = bool(after[-1])
                held = int(starts[0]) if len(starts) else len(values)
                if held:                                           # goes on with the unfinished record
                    pending.append("\n".join(values.slice(0, held).to_pylist()))
                    if not after[held]:
                        yield rows(*here, "whole" if begun == "tail" else "head", True, [first], ["\n".join(pending)])
                        pending.clear()
                        first, begun = False, "tail"
                if len(starts) and open_:                          # the last record is unfinished
                    last, starts = int(starts[-1]), starts[:-1]
                    rest, values = values.slice(last), values.slice(0, last)
                else:
                    rest = None
                if len(starts):
                    firsts = np.zeros(len(starts), bool)
                    firsts[0], first = first, False
                    yield rows(*here, "whole", True, firsts, joined(values.slice(held), starts - held))
                if rest is not None:
                    pending.append("\n".join(rest.to_pylist()))
        yield from flush()

    return lines.mapInArrow(run, PARTS)


def joined_parts(parts: DataFrame) -> DataFrame:
    """Records that cross splits, put together: every tail begins one, the heads behind it
    belong to it. At most two parts a split, one record in a group."""
    order = Window.partitionBy("file").orderBy("split", F.col("part") == "tail")
    numbered = parts.withColumn("no", F.sum((F.col("part") == "tail").cast("int")).over(order))
    texts = F.sort_array(F.collect_list(F.struct("split", "record")))
    return (numbered.groupBy("file", "no").agg(texts.alias("texts"), F.max("first").alias("first"))
            .select("file", "first", F.array_join(F.transform("texts", lambda x: x["record"]), "\n").alias("record")))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file and text of every record behind the headers. Runs the counting scan; call it and
    use its result under :func:`same_splits`."""
    lines = read_lines(spark, path)
    states = stage(split_states(lines), "csv-splits")
    begins, crossed = states.agg(F.count_if("begins_inside"), F.count_if(F.col("begins_inside") | F.col("ends_inside"))).first()
    inside = states.filter("begins_inside")
    few = crossed <= BROADCAST_SPLITS
    parts = record_parts(with_state(lines, inside, few) if begins else lines.withColumn("inside", F.lit(False)))
    records = parts.filter(F.col("part") == "whole").select("file", "first", "record")
    if crossed:
        keys = states.filter(F.col("begins_inside") | F.col("ends_inside")).select("file", "split")
        touched = lines.join(F.broadcast(keys), ["file", "split"]) if few else lines
        crossing = record_parts(with_state(touched, inside, few)).filter(F.col("part") != "whole")
        records = records.unionByName(joined_parts(crossing))
    text = F.regexp_replace("record", "\r$", "")
    return records.filter(~F.col("first")).select("file", text.alias("record")).filter(F.col("record") != "")


def import_csv(spark: SparkSession, schema: T.StructType, path: str) -> CsvImport:
    """Reads a CSV file or folder in parallel and writes its typed rows once (staged)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", {BAD} string"
    with same_splits(spark):
        parsed = csv_records(spark, path).withColumn("row", F.from_csv("record", ddl, PARSE_OPTIONS))
        kept = stage(parsed.select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields],
                                   F.when(F.col(f"row.{BAD}").isNotNull(), F.struct("file", "record")).alias("__bad")), "csv")
    rows = kept.filter(F.col("__bad").isNull()).drop("__bad")
    return CsvImport(rows, kept.filter(F.col("__bad").isNotNull()).select("__bad.file", "__bad.record"))


def drop_import(imported: CsvImport) -> None:
    """Delete the written rows once nothing will read them any more."""
    drop_staged(imported.rows)
