"""Queries p1 to p6: the general training-data operators over the change logs, whole tables each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timeuuid as tu
from tidelog.model import MULTI_CK, SCALAR
from tidelog.operators import asof, dedup, fold, incremental, lateness, skew
from tidelog.operators.changes import KEYS, arrived_us, with_keys
from tidelog.plans.tables import multi_log, scalar_log, table
from tidelog.session import shared_folder
from tidelog.sources.manifest import Incremental

#: 2026-02-10 00:00:00 UTC, the instant at which p5 reads the tables.
P5_NOW_US = 1_770_681_600_000_000
#: p1_new_changes takes the deliveries up to here as stored and those after it as new.
STORED_UP_TO = 700
HEAVY_SHARE = 0.02


def _arrivals(log: DataFrame) -> DataFrame:
    return with_keys(log, arrived_us(log).alias("arrived_us"), F.col("delivery_batch"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated(_arrivals(scalar_log(spark, sf_dir)), KEYS, "arrived_us")


def p1_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scalar_log(spark, sf_dir)
    rows = with_keys(log, arrived_us(log).alias("arrived_us"), *[F.col(c) for c in ("delivery_batch", "cdc$operation", "pk", "ck", "v", "s")])
    return dedup.first_copies(rows, KEYS, "arrived_us").withColumnRenamed("cdc$operation", "operation")


def p1_new_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(scalar_log(spark, sf_dir))
    stored = rows.where(F.col("delivery_batch") <= STORED_UP_TO)
    new = rows.where(F.col("delivery_batch") > STORED_UP_TO)
    return dedup.unseen(new, dedup.first_copies(stored, KEYS, "arrived_us"), KEYS, "arrived_us")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = with_keys(scalar_log(spark, sf_dir), F.col("delivery_batch"))
    return incremental.unprocessed(log, KEYS, "delivery_batch", table(spark, sf_dir, "consumer_runs"))


def p2_pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = scalar_log(spark, sf_dir).groupBy("delivery_batch").agg(F.count(F.lit(1)).alias("n_rows"))
    manifest = incremental.committed_ranges(table(spark, sf_dir, "consumer_runs"))
    return incremental.pending_inputs(listing, manifest, "delivery_batch")


def p2_processed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the log as two runs over its files commit them: the second finds nothing to do."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    runs = Incremental(spark, f"{sf_dir}/scalar_scylla_cdc_log.parquet", f"{folder}/manifest", f"{folder}/out")
    for _ in range(2):
        runs.run(lambda log: with_keys(log, F.col("delivery_batch")))
    return runs.committed().drop("batch")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scalar_log(spark, sf_dir).select(F.hex("cdc$stream_id").alias("stream_id"))
    return skew.heavy_keys(rows, "stream_id", HEAVY_SHARE).select("stream_id")


def p3_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream: copies, first and last change time, and the exact median and 90th percentile of the change time."""
    rows = scalar_log(spark, sf_dir).select(F.hex("cdc$stream_id").alias("stream_id"), tu.micros(F.col("cdc$time")).alias("us"))
    return skew.per_key(rows, "stream_id", "us").toDF("stream_id", "n_rows", "first_us", "last_us", "median_us", "p90_us")


def _changes_with_generation_flag(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    log = scalar_log(spark, sf_dir)
    rows = with_keys(log, F.col("cdc$stream_id").alias("entity"), tu.micros(F.col("cdc$time")).alias("us"), *more)
    generations = table(spark, sf_dir, "cdc_streams_descriptions")
    facts = asof.membership_facts(generations, tu.epoch_us(generations, "time"))
    return asof.as_known(rows, "entity", "us", facts, ["listed"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes_with_generation_flag(spark, sf_dir)
    return rows.where(~F.coalesce("listed", F.lit(False))).select(*KEYS).distinct()


def p4_generation_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change once, with the start of its generation and whether that lists its stream."""
    rows = _changes_with_generation_flag(spark, sf_dir, F.lit("all").alias("scope"))
    generations = table(spark, sf_dir, "cdc_streams_descriptions")
    start = tu.epoch_us(generations, "time")
    facts = generations.select(F.lit("all").alias("entity"), start.alias("valid"), start.alias("known"), start.alias("generation_us"))
    rows = asof.as_known(rows, "scope", "us", facts, ["generation_us"])
    return rows.select(*KEYS, "generation_us", F.coalesce("listed", F.lit(False)).alias("listed")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scalar = fold.current(scalar_log(spark, sf_dir), SCALAR, P5_NOW_US).select(
        F.lit("scalar").alias("base_table"), "pk", F.col("ck").alias("c1"), F.lit(0).cast("long").alias("c2"), "v_time", "s_time"
    )
    multi = fold.current(multi_log(spark, sf_dir), MULTI_CK, P5_NOW_US).select(
        F.lit("multi_ck").alias("base_table"), "pk", "c1", "c2", "v_time", F.lit("").alias("s_time")
    )
    return scalar.unionByName(multi)


def p5_current_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold.current(scalar_log(spark, sf_dir), SCALAR, P5_NOW_US)
    return rows.select("pk", "ck", *[F.when(F.col(f"{c}_time") != "", F.col(f"{c}.value")).alias(c) for c in ("v", "s")])


def _lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = scalar_log(spark, sf_dir)
    rows = with_keys(log, tu.micros(F.col("cdc$time")).alias("us"), arrived_us(log).alias("arrived_us"))
    return lateness.buffered(rows, KEYS, "us", "arrived_us")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateness.corrections(_lateness(spark, sf_dir), ["stream_id"], KEYS, "us").select(*KEYS)


def p6_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateness.per_period(_lateness(spark, sf_dir), ["stream_id"], "us")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_first_copies, p1_new_changes, p2_found, p2_pending_batches, p2_processed_files, p3_found, p3_per_stream,
    p4_found, p4_generation_of_changes, p5_found, p5_current_scalar, p6_found, p6_hourly,
)}
