"""Command line: ``python -m tidelog print LOG`` and ``python -m tidelog replicate LOG REPLICA``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidelog.model import Mode, TableSpec
from tidelog.operators import decode
from tidelog.streaming.engine import CdcEngine
from tidelog.streaming.replica import Replica


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("print", "replicate"):
        s = sub.add_parser(name)
        s.add_argument("log", help="Parquet folder of the log")
        s.add_argument("--generations", help="Parquet table of generations")
        s.add_argument("--ring", help="Parquet table of ring tokens")
        s.add_argument("--tokens", help="Parquet table of stream tokens")
        s.add_argument("--checkpoint", required=True, help="folder for the stream's progress")
        s.add_argument("--once", action="store_true", help="stop at the end of what is there")
        if name == "replicate":
            s.add_argument("replica", help="folder of the replica")
            s.add_argument("-m", "--mode", default="delta", help="delta, preimage or postimage; default delta")
            s.add_argument("-t", "--table", default="table")
            s.add_argument("--partition-key", required=True, nargs="+")
            s.add_argument("--clustering-key", default=[], nargs="*")
            s.add_argument("--ignore", default=[], nargs="*", help="columns of the log that the table doesn't have")
            s.add_argument("--lists", default=[], nargs="*", help="collections of the log that are lists")
            s.add_argument("-cl", "--consistency-level", default="quorum", help="accepted and without effect")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    engine = CdcEngine(spark, a.log, a.generations, a.ring, a.tokens)
    if a.what == "print":

        def show(batch, _):
            for r in decode.printed(batch).toLocalIterator():
                print(r.line)

        consume = show
    else:
        log = decode.without_metadata(engine.batch()).drop(*a.ignore)
        spec = TableSpec.of(a.table, log, tuple(a.partition_key), tuple(a.clustering_key), tuple(a.lists))
        consume = Replica(spark, a.replica, spec, Mode.parse(a.mode)).apply
    engine.stop_on_interrupt()
    engine.fetch_changes(consume, a.checkpoint, a.once).awaitTermination()


if __name__ == "__main__":
    main()
