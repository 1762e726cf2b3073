"""Token counts by a separator scan over flat token files without an index.

A token file is a run of little-endian unsigned 16-bit ids in which each
document ends with the end-of-document id. The files are read by ranges of
bytes, whatever their size, and cut into blocks; one vectorised search for each
block finds the separators, and a prefix scan over the blocks' summaries
stitches documents that cross boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_folder
from .bpe import codec
from .common import stage

END = 50256
BLOCK = 65536
#: Blocks that are read at once.
READ = 64
#: Blocks whose summaries are scanned as one; then their sums are scanned.
RUN = 1024


@lru_cache(64)
def _open(uri: str):
    """(store, path) of a URI, for Python workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def list_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files below ``path``; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")


def write_token_files(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Encodes each partition of ``docs`` into one flat file in ``folder``, and
    returns (name, doc_no, doc_id) of the documents in the files that count:
    keep it in a table, and only those that it names are complete. Null texts
    count as empty: a lone separator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, stop, no = TaskContext.get(), np.array([end], "<u2").tobytes(), 0
        store, root = _open(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId():x}"  # another attempt writes another file
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                c = codec(path, "<u2")
                for t in b.column(1).to_pylist():
                    out.write((c.encode(t) if t else b"") + stop)
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(range(no, no + b.num_rows), pa.int64()), b.column(0)], ["name", "doc_no", "doc_id"])
                no += b.num_rows

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "name string, doc_no bigint, doc_id bigint")


_ENDS = "file string, block bigint, n bigint, ends array<int>"


def _ends(file: list, block: list, parts: list[np.ndarray], end: int) -> pa.RecordBatch:
    ends = pa.array([np.flatnonzero(p == end).astype(np.int32) for p in parts], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), ends], ["file", "block", "n", "ends"])


def file_ends(files: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, block, n, ends) of files (file, length) of any size: tokens of each
    block and the places of its separators. Ranges of a file are dealt to tasks
    and read there from its store; an odd last byte is no token."""
    ranges = files.where("length > 1").select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 2) / (2 * block * READ)))).alias("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, path = _open(file)
                at = r * READ * block
                with store.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(2 * min(READ * block, length // 2 - at), 2 * at), "<u2")
                parts = [data[i : i + block] for i in range(0, len(data), block)]
                yield _ends([file] * len(parts), [r * READ + i for i in range(len(parts))], parts, end)

    return ranges.repartition("file", "range").mapInArrow(run, _ENDS)


def scan_separators(ends: DataFrame) -> DataFrame:
    """(file, doc_no, start, n_tokens, block) of each document, numbered from 0
    within its file; ``start`` counts the tokens before it in the file,
    ``n_tokens`` leaves out its separator, ``block`` is that of its end.

    A document without separator at the end of a file counts too, with the
    last block. Empty files have no document, two separators in a row enclose
    an empty one; an empty table has none. ``ends``: as of file_ends.
    """
    cut = stage(ends, "ends")
    summary = cut.select("file", "block", "n", F.size("ends").cast("bigint").alias("docs"), F.array_max("ends").cast("bigint").alias("last"), F.floor(F.col("block") / RUN).alias("run"))
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    of_block = summary.withColumns({"base": F.coalesce(F.sum("n").over(inner), F.lit(0)), "docs_before": F.coalesce(F.sum("docs").over(inner), F.lit(0))})
    of_block = of_block.withColumn("end_at", F.col("base") + F.col("last"))
    of_block = of_block.withColumn("end_before", F.max("end_at").over(inner))
    runs = of_block.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max("end_at").alias("end_at"), F.max("block").alias("last_block"))
    runs = runs.withColumns({"run_base": F.coalesce(F.sum("n").over(outer), F.lit(0)), "run_docs": F.coalesce(F.sum("docs").over(outer), F.lit(0))})
    runs = runs.withColumn("run_end", F.max(F.col("run_base") + F.col("end_at")).over(outer))
    runs = runs.withColumn("final", F.max("last_block").over(Window.partitionBy("file")))
    stitched = of_block.join(runs.select("file", "run", "run_base", "run_docs", "run_end", "final"), ["file", "run"])
    stitched = stitched.select(
        "file", "block", (F.col("run_base") + F.col("base")).alias("base"), (F.col("run_docs") + F.col("docs_before")).alias("docs_before"),
        F.coalesce(F.col("run_base") + F.col("end_before"), F.col("run_end"), F.lit(-1)).alias("carry"), (F.col("final") == F.col("block")).alias("final"),
    )
    # The places in the file of the block's separators, and of the end of a file that has no separator there.
    places = F.transform("ends", lambda e: e + F.col("base"))
    stop = F.col("base") + F.col("n")
    open_end = F.when(F.col("final") & (F.coalesce(F.try_element_at("places", F.lit(-1)), F.col("carry")) < stop - 1), F.array(stop)).otherwise(F.array().cast("array<bigint>"))
    joined = cut.join(stitched, ["file", "block"]).withColumn("places", places).withColumn("places", F.concat("places", open_end))
    before = F.concat(F.array("carry"), F.col("places"))
    docs = joined.withColumn("before", before).select("file", "block", "docs_before", "before", F.posexplode("places").alias("k", "place"))
    start = F.expr("before[k] + 1")
    return docs.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("place") - start).alias("n_tokens"), "block", F.col("k").alias("place_in_block"))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, file, doc_no, start and n_tokens of each row of ``docs``: the
    texts are written to flat files, and those are scanned.

    Rows with equal or null ids stay apart. A null text counts as empty, with
    no token; texts of any length are encoded whole; an empty table gives one;
    other columns are ignored.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    written = stage(write_token_files(docs, path, folder, doc_id, text), "written")
    named = written.select("name").distinct()
    if named.isEmpty():
        return written.select("doc_id", F.col("name").alias("file"), "doc_no", F.col("doc_no").alias("start"), F.col("doc_no").alias("n_tokens"))
    files = list_token_files(docs.sparkSession, folder)
    name = F.element_at(F.split("file", "/"), -1)
    found = scan_separators(file_ends(files.withColumn("name", name).join(named, "name", "left_semi")))
    return found.withColumn("name", name).join(written, ["name", "doc_no"]).select("doc_id", F.col("name").alias("file"), "doc_no", "start", "n_tokens")
