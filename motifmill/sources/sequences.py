"""Reference texts and reads: from files, and derived from the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.functions.encode import folded
from motifmill.plans.storage import file_state, materialize

ALPHABET = "ACGT"


def read_reference(spark: SparkSession, path: str, *, fasta: bool | None = None, normalize: str | None = None) -> DataFrame:
    """contig_id, seq: a row for each file of headerless text, line ends at the file's end cut, or for each FASTA record, whose symbols may span lines.

    Contigs are numbered by path, records of a file in their order. fasta: None looks
    at the first symbol of the files. ``normalize``: see ``encode.folded``.
    """
    if fasta is None:
        first = spark.read.text(path).first()
        fasta = first is not None and first[0].startswith(">")
    if fasta:
        return read_fasta(spark, path, normalize=normalize).select(F.col("read_id").alias("contig_id"), F.coalesce("q", F.lit("")).alias("seq"))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), folded(F.regexp_replace("value", "[\r\n]+$", ""), normalize).alias("seq"))
    return _numbered(files, "path", "contig_id").select("contig_id", "seq")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, headed, header, q of FASTA records: a header is a line that begins with '>', whatever else it holds."""
    raw = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    begins = raw.where("block = 0").groupBy("path").agg(F.min("at").alias("begin"))  # a row for each file
    marked = raw.join(begins, "path", "left").withColumn("first", F.col("at") == F.col("begin"))
    # only a file's first record still has its '>'
    text = F.when(F.col("first"), F.regexp_replace("value", "^>", "")).otherwise(F.col("value"))
    marked = marked.withColumn("headed", ~F.col("first") | F.col("value").startswith(">")).withColumn("text", F.translate(text, "\r", ""))
    body = F.regexp_replace(F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    parsed = marked.select("path", "block", "at", "headed", F.when(F.col("headed"), F.regexp_extract("text", r"^([^\n]*)", 1)).alias("header"), F.when(F.col("headed"), body).otherwise(F.regexp_replace("text", r"\s", "")).alias("q"))
    return parsed.where("headed or q <> ''")


def read_fasta(spark: SparkSession, path: str, *, normalize: str | None = None) -> DataFrame:
    """read_id, header, q, len of FASTA records in the order of path and place; sequences may span lines. Records without a sequence have a null q and len 0; what stands before a file's first header is in ``rejected_fasta``. ``normalize``: see ``encode.folded``."""
    q = F.when(F.col("q") != "", folded(F.col("q"), normalize))
    parsed = _records(spark, path).where("headed").select("path", "block", "at", "header", q.alias("q"))
    return _numbered(parsed, "path", "read_id", "block", "at").select("read_id", "header", "q", F.coalesce(F.length("q"), F.lit(0)).alias("len"))


def rejected_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, header, q, reason of what is no whole record: 'no header' or 'no sequence'."""
    bad = _records(spark, path).where("not headed or q = ''")
    return bad.select("path", "header", F.when(F.col("q") != "", F.col("q")).alias("q"), F.when(~F.col("headed"), "no header").otherwise("no sequence").alias("reason"))


def write_fasta(reads: DataFrame, path: str) -> None:
    """Two lines a record."""
    reads.select(F.concat(F.lit(">"), F.coalesce("header", F.col("read_id").cast("string")), F.lit("\n"), F.coalesce("q", F.lit("")))).write.text(path)


def _numbered(df: DataFrame, *names: str) -> DataFrame:
    """Ordinals from 0 in the order of the columns (the second name is the new column's)."""
    order = [names[0], *names[2:]]
    return global_index(df, order, names[1])


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 in a total order, without bringing all rows to one task.

    Rows are range-partitioned and sorted, and each partition's rows are numbered
    from the number of rows in the partitions before it.
    """
    parted = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    parts = parted.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offset, begins = 0, []
    for part, n in sorted((r[0], r[1]) for r in parts):
        begins.append((part, offset))
        offset += n
    offsets = df.sparkSession.createDataFrame(begins, "_part long, _offset long") if begins else df.sparkSession.createDataFrame([], "_part long, _offset long")
    numbered = parted.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")  # one row a partition
    return numbered.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_offset")


def genome_of(documents: DataFrame) -> DataFrame:
    """contig_id, seq: the letters A, C, G and T of every text, in capitals; null texts give empty contigs."""
    letters = F.translate(F.coalesce("text", F.lit("")), "acgt", ALPHABET)
    return documents.select(F.col("doc_id").alias("contig_id"), F.regexp_replace(letters, "[^ACGT]", "").alias("seq"))


def genome_with_unknowns(documents: DataFrame) -> DataFrame:
    """contig_id, seq: as ``genome_of``, with the letter N, which stands for an unknown symbol, kept too."""
    letters = F.translate(F.coalesce("text", F.lit("")), "acgtn", ALPHABET + "N")
    return documents.select(F.col("doc_id").alias("contig_id"), F.regexp_replace(letters, "[^ACGTN]+", "").alias("seq"))


def reads_of(genome: DataFrame) -> DataFrame:
    """read_id, q: a substring of 7 to 20 symbols, fewer at a contig's end, of every contig that is not empty."""
    start = 1 + F.col("contig_id") * 7919 % F.greatest(F.length("seq"), F.lit(1))
    return genome.where(F.length("seq") > 0).select(F.col("contig_id").alias("read_id"), F.substring("seq", start.cast("int"), (7 + F.col("contig_id") % 14).cast("int")).alias("q"))


_genomes: dict[tuple, DataFrame] = {}


def input_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Changes with the session and with the files of a data directory's documents."""
    return spark.sparkContext.applicationId, sf_dir, file_state(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived reference of a data directory, written once a session and state of its files."""
    key = input_key(spark, sf_dir)
    if key not in _genomes:
        _genomes[key] = materialize(genome_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "genome")
    return _genomes[key]
