"""FASTA files as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from proteinscan.functions.alphabet import clean

def _numbered(raw: DataFrame) -> DataFrame:
    """Raw pieces `file, block, value` with `row`, their number inside the block.

    A block of a file is read by one task from its start to its end, so a change of file or block is
    the start of one.
    """

    def number(batches):
        last, row = (None, None), -1
        for batch in batches:
            files, blocks = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])
            if batch.num_rows:
                new[0] = (files[0], blocks[0]) != last
                last = (files[-1], blocks[-1])
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            rows = np.where(start >= 0, at - start, row + 1 + at)
            row = int(rows[-1]) if len(rows) else row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], names=[*batch.schema.names, "row"])

    return raw.mapInArrow(number, "file string, block long, value string, row long")


def parse(reader: DataFrameReader | DataStreamReader, path: str | list[str], strict: bool = False) -> DataFrame:
    """`input_pos, header, seq, length` of every record that `reader`, of a batch or a stream, finds.

    Pieces end at `>` on a line start, which the split takes away; the first piece of a file still
    has its own. So a header may begin with or hold further `>`.
    """
    raw = reader.option("lineSep", "\n>").text(path)
    rows = _numbered(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    first = (F.col("block") == 0) & (F.col("row") == 0)
    value = F.when(first, F.regexp_replace("value", "^>", "")).otherwise(F.col("value"))
    rows = rows.select(F.struct("file", "block", "row").alias("input_pos"), value.alias("value")).where(F.trim("value") != "")
    header = F.regexp_replace(F.regexp_extract("value", r"^([^\n]*)", 1), r"\r$", "")
    body = F.regexp_replace("value", r"^[^\n]*\n?", "")
    rows = rows.select("input_pos", header.alias("header"), clean(body, strict).alias("seq"))
    return rows.withColumn("length", F.length("seq"))


def read_fasta(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """`input_pos, header, seq, length` of every record.

    Files are split at `>` on a line start, so large files are read in parallel. Blank lines, CR LF
    and a missing last newline are harmless; a record may have no residues. `input_pos` is ordered
    like the input: by file, place in the file, and record.
    """
    return parse(spark.read, path, strict)


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """Write `header` and `seq` as FASTA text, `width` residues a line.

    Every row is a record: a null header is an empty one, a null sequence has no residues, and line
    breaks in a header become spaces.
    """
    header = F.regexp_replace(F.coalesce("header", F.lit("")), "[\r\n]+", " ")
    folded = F.regexp_replace(F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})", "$1\n"), "\n$", "")
    rows.select(F.concat(F.lit(">"), header, F.lit("\n"), folded)).write.text(path)
