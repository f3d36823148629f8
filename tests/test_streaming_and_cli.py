"""Streams of reads and the command line."""

import pytest

from motifmill import cli
from motifmill.operators.rank_search import RankBins
from motifmill.plans import storage
from motifmill.streaming import reads as rs


def test_stream(spark, tmp_path):
    texts = spark.createDataFrame([(0, "GATTACAGATTACAGATTACA"), (1, "ACGTACGTACGTACG")], "contig_id long, seq string")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "GATTACA"), (2, "TTTT")], "read_id long, q string").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame([(3, "ACGTACGTACGT"), (4, "GATTACAGATTACA")], "read_id long, q string").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema("read_id long, q string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = rs.count_stream(stream, texts, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert {r.read_id: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 3, 2: 0, 3: 1, 4: 2}
    seeds = rs.seed_table(texts)
    sink = rs.screen(stream, seeds).writeStream.format("memory").queryName("screened").start()
    sink.processAllAvailable()
    sink.stop()
    got = {r.read_id: r.seeds_found for r in spark.sql("select * from screened").collect()}
    assert got[2] == 0 and got[3] == 1 and got[4] == 2


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "ref.txt").write_text("GATTACAGATTACA\n")
    (tmp_path / "reads.fa").write_text(">a\nATTA\n>b\nCAG\n>c\nGGGG\n")
    assert cli.main(["build", str(tmp_path / "ref.txt"), str(tmp_path / "index")]) == 0
    assert spark.read.parquet(str(tmp_path / "index/bwt")).count() == 15
    assert cli.main(["count", str(tmp_path / "ref.txt"), str(tmp_path / "reads.fa"), "--runs", "2", "--out", str(tmp_path / "counts")]) == 0
    assert "occurrences 3;" in capsys.readouterr().out
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == [0, 1, 2]


def test_cli_counts_in_what_it_built(spark, tmp_path, capsys):
    (tmp_path / "ref.txt").write_text("GATTACAGATTNCA\n")
    (tmp_path / "reads.fa").write_text(">a\nATTA\n>b\nTNC\n>c\nGAT\n")
    assert cli.main(["build", str(tmp_path / "ref.txt"), str(tmp_path / "index"), "--longest", "20"]) == 0
    (tmp_path / "ref.txt").unlink()
    assert cli.main(["count", str(tmp_path / "reads.fa"), "--index", str(tmp_path / "index"), "--runs", "2", "--out", str(tmp_path / "counts")]) == 0
    assert "occurrences 4;" in capsys.readouterr().out
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == [1, 1, 2]
    with pytest.raises(SystemExit):
        cli.main(["count", str(tmp_path / "reads.fa")])
    assert cli.main(["dump", str(tmp_path / "index"), str(tmp_path / "dump"), "--symbols", "4"]) == 0
    pieces = spark.read.parquet(str(tmp_path / "dump")).orderBy("contig_id", "piece").collect()
    text = "GATTACAGATTNCA$"
    order = sorted(range(len(text)), key=lambda p: text[p:])
    assert "".join(r.b0 for r in pieces) == "".join(text[p - 1] for p in order) and [len(r.b1) for r in pieces] == [4, 4, 4, 3]


def test_stream_over_bins(spark, tmp_path):
    texts = spark.createDataFrame([(0, "GATTACAGATTACAGATTACA")], "contig_id long, seq string")
    bins = RankBins.build(texts, 20)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "GATTACA"), (2, "TTTT"), (3, None)], "read_id long, q string").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema("read_id long, q string").parquet(str(tmp_path / "in/*"))
    query = rs.count_stream(stream, bins, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert {r.read_id: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 3, 2: 0, 3: None}


def test_cli_checks(tmp_path, spark):
    with pytest.raises(SystemExit):
        cli.main(["count", str(tmp_path / "no.txt"), str(tmp_path / "no.fa")])
    with pytest.raises(SystemExit):
        cli.main(["count", "a", "b", "--threads", "0"])
    assert [cli.runs(x) for x in ("1", "2", "128", "129")] == [5, 2, 128, 5]


def test_stream_of_longer_reads(spark, tmp_path):
    """A read longer than the cut allows for, and nothing left of what batches wrote on their way."""
    text = "GATTACACCA" * 60
    texts = spark.createDataFrame([(0, text)], "contig_id long, seq string")
    (tmp_path / "in").mkdir()
    for k, q in enumerate(["GATTACA", text[3:80], "CCAGATT"]):
        spark.createDataFrame([(k, q)], "read_id long, q string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("read_id long, q string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    before = len(storage._made)
    query = rs.count_stream(stream, texts, str(tmp_path / "out"), str(tmp_path / "check"), longest=20)
    query.processAllAvailable()
    query.stop()
    assert {r.read_id: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: sum(text.startswith(q, i) for i in range(len(text))) for k, q in enumerate(["GATTACA", text[3:80], "CCAGATT"])}
    assert len(storage._made) <= before + 2
