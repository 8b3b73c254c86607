"""Processing only new or changed input files, with a manifest.

A run lists the input's files and anti-joins the listing against the manifest of what has been committed, first by size and
time of change; only files that remain are read for their checksum, and what the manifest has under that checksum (a file
that was merely touched) isn't new either. The rest is one batch, named by a hash of its files; its output is written to
``batch=<id>``, replacing what a failed attempt left there, and then the manifest entry is committed by renaming a finished
folder into place. Readers take only the batches that the manifest names, so an output without a commit doesn't exist for them.

A failure before the commit leaves nothing visible, and the next run does the batch again; one after it changes nothing.

A file whose content changed supersedes the batch that had it: the other files of that batch, in their present state, join the new
batch, whose entry names the batches it replaces, and readers leave those out. So the output is that of each file once, in
its latest committed state, whatever the work does with its rows. Files that are gone keep their output.

Names and sizes of files go through Spark's own index of files; the names of one run's new files come to the driver, which reads
them as one table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("changed_us", T.LongType())])
SUMMED = T.StructType([*LISTED.fields, T.StructField("checksum", T.StringType())])
ENTRY = T.StructType([*SUMMED.fields, T.StructField("batch", T.StringType()), T.StructField("replaces", T.ArrayType(T.StringType()))])
CHUNK = 8 << 20


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def listing(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """(path, size, changed_us) of the files under ``folder``, whose contents aren't read; nothing where it doesn't exist."""
    fs, root, _ = _fs(spark, folder)
    if not fs.exists(root):
        return spark.createDataFrame([], LISTED)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("changed_us"))


def with_checksums(files: DataFrame) -> DataFrame:
    """``files`` (path, size, changed_us) with the checksum of their content, read in the executors a chunk at a time."""

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyarrow import fs as pafs

        for b in batches:
            sums = []
            for path in b.column(0).to_pylist():
                source, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                h = xxhash.xxh3_128()
                with source.open_input_stream(inner) as f:
                    while chunk := f.read(CHUNK):
                        h.update(chunk)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], names=SUMMED.names)

    # Files differ in size: few of them to a task.
    return files.select(*LISTED.names).repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(checksums, SUMMED)


class Incremental:
    """One input folder, one manifest folder and one output folder."""

    def __init__(self, spark: SparkSession, source: str, manifest: str, output: str) -> None:
        self.spark, self.source, self.manifest_dir, self.output = spark, source, manifest, output

    def manifest(self) -> DataFrame:
        """One row per file of the batches that hold; those that a later one replaced are left out."""
        fs, root, _ = _fs(self.spark, self.manifest_dir)
        if not fs.exists(root) or not any(s.getPath().getName().startswith("batch-") for s in fs.listStatus(root)):
            return self.spark.createDataFrame([], ENTRY)
        entries = self.spark.read.schema(ENTRY).parquet(f"{self.manifest_dir}/batch-*")
        gone = entries.select(F.explode("replaces").alias("gone_batch")).distinct()
        return entries.join(gone, F.col("batch") == F.col("gone_batch"), "left_anti")

    def candidates(self) -> DataFrame:
        """The listed files that the manifest doesn't have with their size and time of change; only these are read."""
        return listing(self.spark, self.source).join(self.manifest(), ["path", "size", "changed_us"], "left_anti")

    def pending(self) -> DataFrame:
        """The files that no holding batch has processed in their present state, with checksums."""
        return with_checksums(self.candidates()).join(self.manifest(), ["path", "size", "checksum"], "left_anti").select(*SUMMED.names)

    def run(self, work: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> str | None:
        """Process what is pending; the batch's name, or None if there was nothing."""
        files = {r.path: r for r in self.pending().collect()}  # names of one run's new files
        if not files:
            return None
        known = self.manifest()
        changed = self.spark.createDataFrame([(p,) for p in files], "path string")
        replaced = known.join(changed, "path", "left_semi").select("batch").distinct()
        replaces = sorted(r.batch for r in replaced.collect())
        if replaces:
            again = known.join(replaced, "batch", "left_semi").join(changed, "path", "left_anti").select(*SUMMED.names)
            files |= {r.path: r for r in again.join(listing(self.spark, self.source).select("path"), "path", "left_semi").collect()}
        rows = [files[p] for p in sorted(files)]
        batch = hashlib.sha256("\n".join(f"{r.path} {r.size} {r.checksum}" for r in rows).encode()).hexdigest()[:24]
        work(self.spark.read.parquet(*[r.path for r in rows])).write.mode("overwrite").parquet(f"{self.output}/batch={batch}")
        if before_commit:
            before_commit()
        waiting = f"{self.manifest_dir}/_waiting-{batch}"
        entries = [(r.path, r.size, r.changed_us, r.checksum, batch, replaces) for r in rows]
        self.spark.createDataFrame(entries, ENTRY).coalesce(1).write.mode("overwrite").parquet(waiting)
        fs, _, path = _fs(self.spark, self.manifest_dir)
        if not fs.rename(path(waiting), path(f"{self.manifest_dir}/batch-{batch}")):
            raise RuntimeError(f"batch {batch} couldn't be committed")
        return batch

    def committed(self) -> DataFrame | None:
        """The output of all batches that hold, with column ``batch``; None before the first."""
        names = [r.batch for r in self.manifest().select("batch").distinct().collect()]
        return self.spark.read.option("basePath", self.output).parquet(*[f"{self.output}/batch={n}" for n in names]) if names else None
