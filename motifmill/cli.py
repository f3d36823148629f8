"""Command line: build an index of reference texts, count reads in them.

    python -m motifmill.cli build REFERENCE INDEX_DIR [--longest 256] [--threads 8]
    python -m motifmill.cli count REFERENCE READS.fa [--runs 5] [--threads 8] [--search seeds|ranks] [--normalize upper] [--out DIR]
    python -m motifmill.cli count READS.fa --index INDEX_DIR [...]

With --index the bins that build wrote are searched and no reference is read.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motifmill.operators import search
from motifmill.operators.index import DUMP, Index, dumped
from motifmill.operators.metrics import written_counts
from motifmill.operators.rank_search import RankBins
from motifmill.sources.sequences import read_fasta, read_reference


def runs(text: str) -> int:
    """From 2 to 128; anything else means 5."""
    n = int(text)
    return n if 2 <= n <= 128 else 5


def threads(text: str) -> int:
    """At least 1."""
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("at least one thread")
    return n


def there(spark: SparkSession, path: str) -> str:
    """The path, if the file system has something there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise SystemExit(f"nothing at {path}")
    return path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="motifmill")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("reference")
    build.add_argument("index")
    build.add_argument("--longest", type=threads, default=256, help="symbols of the longest read that the index is for")
    count = commands.add_parser("count")
    count.add_argument("reference", nargs="?")
    count.add_argument("reads")
    count.add_argument("--runs", type=runs, default=5)
    count.add_argument("--out")
    count.add_argument("--index", help="what build wrote")
    count.add_argument("--search", choices=("seeds", "ranks"), default="seeds")
    dump = commands.add_parser("dump", help="the transform's columns in pieces, sorted by contig and piece")
    dump.add_argument("index")
    dump.add_argument("out")
    dump.add_argument("--symbols", type=threads, default=DUMP, help="of a piece")
    for command in (build, count, dump):
        command.add_argument("--threads", type=threads, help="of a local session; a cluster's own setting holds otherwise")
    for command in (build, count):
        command.add_argument("--normalize", choices=("upper",))
    args = parser.parse_args(argv)
    builder = SparkSession.builder
    spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    if args.command == "count" and (args.reference is None) == (args.index is None):
        parser.error("count takes a reference or --index")
    if args.command == "dump":
        pieces = dumped(Index.load(spark, there(spark, args.index)).bwt, args.symbols)
        pieces.repartitionByRange("contig_id", "piece").sortWithinPartitions("contig_id", "piece").write.parquet(args.out)
        return 0
    if args.command == "build" or args.index is None:
        texts = read_reference(spark, there(spark, args.reference), normalize=args.normalize)
    if args.command == "build":
        Index.build(texts).save(args.index)
        RankBins.build(texts, args.longest).save(f"{args.index}/bins")
        return 0
    reads = read_fasta(spark, there(spark, args.reads), normalize=args.normalize).select("read_id", "q")
    if args.index:
        find = RankBins.load(spark, there(spark, f"{args.index}/bins")).count
    elif args.search == "ranks":
        find = RankBins.build(texts, reads.agg(F.max(F.length("q"))).first()[0] or 1).count
    else:
        held = search.Texts(texts)  # cut in the first run
        find = lambda reads: search.count_matches(held, reads)
    seconds, totals = [], []
    for _ in range(args.runs):
        began = time.perf_counter()
        counts = find(reads)
        if args.out:  # counts are written and summed up by one job
            totals.append(written_counts(counts, args.out)["total"])
        else:
            totals.append(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        seconds.append(time.perf_counter() - began)
    if len(set(totals)) != 1:
        raise RuntimeError(f"runs differ: {totals}")
    rest = seconds[1:]
    print(f"occurrences {totals[0]}; seconds best {min(rest):.3f}, mean {sum(rest) / len(rest):.3f}, most {max(rest):.3f} (first run left out)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
