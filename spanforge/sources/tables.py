"""Tab-separated tables, annotation and SAM text as DataFrames, and tables written back.

Spark's readers take files, folders, globs and gzip alike, and lines may end in CRLF.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge import schemas
from spanforge.functions import text
from spanforge.operators import sets


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, provenance: bool = False) -> DataFrame:
    """A table with a header row; cells are text unless a schema is given. provenance: adds file_name, and file_sample, the name up to its first dot."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if provenance:
        df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
        df = df.withColumn("file_sample", sample_of(F.col("file_name")))
    return df


def sample_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"^([^.]+)", 1)


def checked_samples(df: DataFrame) -> DataFrame:
    """A table read with provenance, which raises where a row's sample isn't its file's, or a sample has two files. An empty sample is taken from the file's name."""
    named = df.withColumn("sample", F.coalesce(F.when(F.col("sample") != "", F.col("sample")), F.col("file_sample")))
    files = named.groupBy("sample").agg(F.count_distinct("file_name").alias("__files"))
    both = sets.require(named, F.col("sample") == F.col("file_sample"), "a file holds another sample than its name says")
    single = sets.require(files, F.col("__files") == 1, "a sample has two files").drop("__files")
    return both.join(F.broadcast(single), "sample")


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds ordinal, the place of a row: files by their name, whatever their sizes, and then their lines. For tables of text, whose rows have no place of their own.

    A file's rows are in its splits, in the order of their bytes; numbers are given by split, so they rise but have gaps.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.select("*", place.alias("ordinal"))


def scratch(spark: SparkSession) -> str:
    """A new folder for files that are read again: in spark.checkpoint.dir, which driver and executors share, or, with a local master, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spanforge-files-")
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of exactly nine tab-separated fields; comments and all others are skipped."""
    fields = F.split(F.col("value"), "\t")
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value")).where(~F.col("value").startswith("#")).select(fields.alias("f")).where(F.size("f") == 9)
    return lines.select(*[F.get("f", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.GTF)])


def read_branchpoints(spark: SparkSession, path: str) -> DataFrame:
    """Branchpoint scores in file order; the chromosome may be called chr or seqnames, and the intron type may be missing."""
    raw = read_tsv(spark, path)
    has = set(raw.columns)
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("chr", "seqnames") if c in has]
    if not named:
        raise ValueError("a branchpoint table needs a chr or seqnames column")
    intron_type = F.coalesce("intron_type", F.lit("")) if "intron_type" in has else F.lit("")
    return in_file_order(raw).select(F.coalesce(*named).alias("chrom"), F.col("start").cast("long").alias("position"), "strand", F.col("score").cast("double").alias("score"), intron_type.alias("intron_type"), "ordinal")


def read_selected_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, transcript_id): the first transcript of each gene in file order."""
    raw = in_file_order(read_tsv(spark, path))
    return raw.groupBy("gene_id").agg(F.min_by("transcript_id", "ordinal").alias("transcript_id"))


def read_sam(spark: SparkSession, path: str | list[str], sample: str | None = None) -> DataFrame:
    """Alignments of SAM text, headers skipped; nh is the NH tag or null. Without a sample the file's name up to its first dot is it."""
    # Casts are tried: a later filter may be run on a line before the one that leaves headers out.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    f = F.split(F.regexp_replace("value", r"\r$", ""), "\t")
    rows = lines.where(~F.col("value").startswith("@")).select("file", f.alias("f")).where(F.size("f") >= 11)
    nh = F.regexp_extract(F.array_join(F.slice("f", 12, 1000), "\t"), r"(?:^|\t)NH:i:(\d+)", 1)
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(
        (F.lit(sample) if sample is not None else sample_of(F.col("file"))).alias("sample"),
        at(0).alias("qname"),
        at(1).try_cast("int").alias("flag"),
        F.when(at(2) != "*", at(2)).alias("rname"),
        at(3).try_cast("long").alias("pos"),
        at(4).try_cast("int").alias("mapq"),
        F.when(at(5) != "*", at(5)).alias("cigar"),
        F.when(at(6) == "=", F.when(at(2) != "*", at(2))).when(at(6) != "*", at(6)).alias("rnext"),
        at(7).try_cast("long").alias("pnext"),
        at(8).try_cast("long").alias("tlen"),
        F.when(nh != "", nh).cast("int").alias("nh"),
    )


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, gzip: bool = False, na: bool = False, mode: str = "errorifexists") -> None:
    """A folder with one part, columns in the given order and rows in df's. na: nulls are written as NA, else as nothing. For tables that people read; results that are read again are better kept as Parquet."""
    out = df.select(*columns) if columns else df
    writer = out.coalesce(1).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "NA" if na else "").option("emptyValue", "")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_tsv_file(df: DataFrame, path: str, columns: Sequence[str] | None = None, gzip: bool = False, na: bool = False) -> None:
    """As write_tsv(), but the part is moved to be a file of the given name."""
    folder = f"{path}.parts"
    write_tsv(df, folder, columns, gzip, na)
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(folder)
    system = source.getFileSystem(conf)
    part = system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))[0].getPath()
    if not system.rename(part, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{path} can't be written")
    system.delete(source, True)


def write_reference(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The tables of a reference as Parquet, each in a folder of its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_reference(spark: SparkSession, path: str, name: str, schema: T.StructType | None = None, categories: Sequence[str] = ()) -> DataFrame:
    """A table of a reference. Raises if it lacks columns of the schema, or any of the categories: it is then of another version."""
    df = spark.read.parquet(f"{path}/{name}")
    missing = [f.name for f in schema or () if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}/{name} lacks {', '.join(missing)}; build the reference again")
    if categories:
        there = {r["category"] for r in df.where(F.col("category").isin(*categories)).select("category").distinct().collect()}
        if gone := sorted(set(categories) - there):
            raise ValueError(f"{path}/{name} lacks the categories {', '.join(gone)}; build the reference again")
    return df


def attributes(gtf: DataFrame, *keys: str) -> DataFrame:
    """gtf with a column for each attribute; gene_type falls back on gene_biotype."""
    return gtf.withColumns({k: F.coalesce(text.gtf_attribute(F.col("attributes"), "gene_type"), text.gtf_attribute(F.col("attributes"), "gene_biotype")) if k == "gene_type" else text.gtf_attribute(F.col("attributes"), k) for k in keys})
