"""Processing only what no successful run has processed.

A manifest says which inputs committed runs have covered; the listing of inputs is anti-joined against it.
Here inputs are the delivery batches of a log and the manifest comes from status reports of runs. The same for
input files, with size and checksum, is in ``tidelog.sources.manifest``.

Nulls: a run without bounds covers nothing; a row without a delivery batch has not been processed.
Ties and repeats: repeated reports count once, a run is committed if any of its reports says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeuuid import floor_div
from tidelog.session import small_side

#: Batches per block of the interval join: a run is repeated once per block it touches, not once per batch.
BLOCK = 1024
#: A listing with no more rows than this is broadcast: two numbers a row, some 50 MB at most.
LISTING_ROWS = 2_000_000


def committed_ranges(runs: DataFrame) -> DataFrame:
    """(first_batch, last_batch) of each committed run, both inclusive; the manifest."""
    return (
        runs.where((F.col("status") == "committed") & (F.col("first_batch") <= F.col("last_batch")))
        .select(F.col("first_batch").cast("long"), F.col("last_batch").cast("long"))
        .distinct()
    )


def pending_inputs(listing: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """The rows of ``listing`` whose number ``name`` lies in no range of ``manifest``.

    An anti-join on blocks of numbers with the range as residual condition: hashed, never a nested loop.
    """
    number = F.col(f"`{name}`").cast("long")
    blocks = manifest.select(
        "first_batch",
        "last_batch",
        F.explode(
            F.sequence(floor_div(F.col("first_batch"), BLOCK), floor_div(F.col("last_batch"), BLOCK))
        ).alias("manifest_block"),
    )
    inside = (
        (floor_div(number, BLOCK) == F.col("manifest_block"))
        & (number >= F.col("first_batch"))
        & (number <= F.col("last_batch"))
    )
    return listing.join(blocks, inside, "left_anti")


def unprocessed(df: DataFrame, keys: Sequence[str], batch: str, runs: DataFrame) -> DataFrame:
    """The identifiers none of whose copies came with a batch that a committed run covers, each once.

    ``df`` has ``keys`` and ``batch``. Copies are folded to one flag per identifier before the shuffle.
    """
    listing = df.select(F.col(f"`{batch}`").alias("pending_batch")).where("pending_batch is not null").distinct()
    pending = small_side(pending_inputs(listing, committed_ranges(runs), "pending_batch"), LISTING_ROWS)
    marked = df.join(pending, F.col(f"`{batch}`") == F.col("pending_batch"), "left")
    done = (F.col(f"`{batch}`").isNotNull() & F.col("pending_batch").isNull()).cast("int")
    return (
        marked.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.max(done).alias("copy_done"))
        .where("copy_done = 0")
        .select(*[f"`{k}`" for k in keys])
    )
