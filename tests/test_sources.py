import gzip
import struct
import zlib
from pathlib import Path

import genome
import pytest
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.sources import binary, tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sources")
    (d / "a.gtf").write_text(genome.GTF)
    (d / "b.gtf.gz").write_bytes(gzip.compress(genome.GTF.encode()))
    (d / "bp.tsv").write_text(genome.BRANCHPOINTS, newline="")
    (d / "s1.x.sam").write_text("\n".join(genome.SAM) + "\n")
    (d / "s1.x.bam").write_bytes(genome.bam_bytes(genome.SAM))
    (d / "r.fastq").write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nAC\n+\nII\n")
    (d / "r.fastq.gz").write_bytes(gzip.compress((d / "r.fastq").read_bytes()))
    (d / "g.fa").write_text(">one x\nACGT\nAC\n>two\n\nGG\n")
    return d


def test_gtf_keeps_lines_of_nine_fields(spark, folder):
    for name in ("a.gtf", "b.gtf.gz"):
        rows = tables.read_gtf(spark, str(folder / name))
        assert rows.count() == 12 and rows.columns == schemas.GTF.names
        typed = tables.attributes(rows, "gene_type").where("gene_type = 'lincRNA'").first()
        assert (typed["start"], typed["end"]) == (2001, 2100)


def test_branchpoints_with_either_name(spark, folder):
    rows = tables.read_branchpoints(spark, str(folder / "bp.tsv")).orderBy("ordinal").collect()
    assert [(r["chrom"], r["position"], r["score"]) for r in rows[:2]] == [("chr1", 275, 0.9), ("chr1", 280, 0.9)] and rows[3]["intron_type"] == "U12"
    other = folder / "bp2.tsv"
    other.write_text("seqnames\tstart\tstrand\tscore\nchr2\t5\t-\t1\n")
    assert tuple(tables.read_branchpoints(spark, str(other)).first())[:5] == ("chr2", 5, "-", 1.0, "")
    (folder / "bp3.tsv").write_text("start\tstrand\tscore\n5\t-\t1\n")
    with pytest.raises(ValueError, match="seqnames"):
        tables.read_branchpoints(spark, str(folder / "bp3.tsv"))


def test_bam_equals_sam(spark, folder):
    binary.register(spark)
    sam = tables.read_sam(spark, str(folder / "s1.x.sam"))
    bam = spark.read.format("bam").load(str(folder / "s1.x.bam"))
    assert bam.schema.names == schemas.ALIGNMENTS.names == sam.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, bam.collect())) == sorted(map(key, sam.collect()))
    assert sam.count() == len([x for x in genome.SAM if x[0] != "@"])
    assert spark.read.format("bam").option("sample", "zz").load(str(folder / "s1.x.bam")).select("sample").distinct().first()[0] == "zz"
    assert sam.where("qname = 'no_mate'").first()["nh"] is None and sam.where("qname = 'multi'").first()["nh"] == 3


def test_broken_bam(spark, folder):
    binary.register(spark)
    (folder / "bad.bam").write_bytes(genome.bam_bytes(genome.SAM)[:20] + b"")
    (folder / "cut.bam").write_bytes(gzip.compress(gzip.decompress(genome.bam_bytes(genome.SAM))[:-3]))
    with pytest.raises(Exception, match="ends inside a record"):
        spark.read.format("bam").load(str(folder / "cut.bam")).count()
    (folder / "no.bam").write_bytes(b"SAM?text")
    with pytest.raises(Exception, match="not a BAM"):
        spark.read.format("bam").load(str(folder / "no.bam")).count()


def bgzf(parts):
    """Packed blocks of the parts, and the virtual offset of each part's beginning."""
    out, offsets = b"", []
    for data in [*parts, b""]:
        offsets.append(len(out) << 16)
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    return out, offsets


def indexed(folder, n=300):
    """A sorted BAM file of one chromosome with an index, five records a block, and its SAM lines."""
    lines = [genome.sam_line(f"q{i}", 0, "chr1", 1 + 400 * i, 60, "50M300N50M" if i % 7 == 0 else "30M", "=", 1, 0, 1) for i in range(n)]
    head = ["@SQ\tSN:chr1\tLN:5000"]
    plain = gzip.decompress(genome.bam_bytes([*head, *lines]))
    at, records = len(gzip.decompress(genome.bam_bytes(head))), []
    start = at
    while at < len(plain):
        size = struct.unpack_from("<i", plain, at)[0] + 4
        records.append(plain[at : at + size])
        at += size
    blocks = [b"".join(records[i : i + 5]) for i in range(0, n, 5)]
    data, offsets = bgzf([plain[:start], *blocks])
    (folder / "big.bam").write_bytes(data)
    (folder / "plain").mkdir()
    (folder / "plain/big.bam").write_bytes(data)
    places = [offsets[1 + i // 5] | sum(map(len, records[i - i % 5 : i])) for i in range(n)] + [offsets[-1]]
    bins, linear = {}, {}
    for i in range(n):
        a = 400 * i
        b = a + (400 if i % 7 == 0 else 30)
        level = next(s for s in (14, 17, 20, 23, 26, 29) if a >> s == (b - 1) >> s)
        number = ((1 << 29 - level) - 1) // 7 + (a >> level)
        bins.setdefault(number, []).append((places[i], places[i + 1]))
        for w in range(a >> 14, ((b - 1) >> 14) + 1):
            linear.setdefault(w, places[i])
    index = b"BAI\x01" + struct.pack("<ii", 1, len(bins))
    for number, chunks in bins.items():
        index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    index += struct.pack("<i", len(linear)) + b"".join(struct.pack("<Q", linear[w]) for w in sorted(linear))
    (folder / "big.bam.bai").write_bytes(index)
    return lines


def test_indexed_bam_is_split_and_read_by_region(spark, tmp_path):
    binary.register(spark)
    lines = indexed(tmp_path)
    (tmp_path / "big.sam").write_text("\n".join(lines) + "\n")
    key = lambda r: tuple(str(x) for x in r)
    sam = sorted(map(key, tables.read_sam(spark, str(tmp_path / "big.sam")).collect()))
    split = spark.read.format("bam").option("splitBytes", 600).load(str(tmp_path / "big.bam"))
    whole = spark.read.format("bam").load(str(tmp_path / "plain/big.bam"))
    assert split.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    assert sorted(map(key, split.collect())) == sam == sorted(map(key, whole.collect()))
    for region, first, last in (("chr1:40,001-60,500", 100, 151), ("chr1:2900-3100", 7, 7), ("chr1", 0, 299), ("chr2:1-9", 1, 0), ("chr1:1-1", 0, 0)):
        for path in ("big.bam", "plain/big.bam"):
            rows = spark.read.format("bam").option("region", region).load(str(tmp_path / path))
            assert sorted(int(r["qname"][1:]) for r in rows.collect()) == list(range(first, last + 1)), (region, path)
    reader = binary.BamReader({"path": str(tmp_path / "big.bam"), "region": "chr1:40001-60500"})
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 52
    assert min(p.start for p in reader.partitions()) > 0


def test_fastq_and_fasta(spark, folder):
    binary.register(spark)
    for name in ("r.fastq", "r.fastq.gz"):
        rows = spark.read.format("fastq").load(str(folder / name)).orderBy("ordinal").collect()
        assert [tuple(r) for r in rows] == [(0, "r1 x", "ACGT", "@@@@"), (1, "r2", "AC", "II")]
        assert binary.count_fastq(spark, str(folder / name)) == 2
    rows = spark.read.format("fasta").load(str(folder / "g.fa")).orderBy("ordinal").collect()
    assert [tuple(r) for r in rows] == [(0, "one x", "ACGTAC"), (1, "two", "GG")]


def test_tsv_round_trip_with_missing_cells(spark, folder):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 0.5)], "x string, n long, v double").orderBy("x")
    for gz in (False, True):
        path = str(folder / f"out{gz}")
        tables.write_tsv(df, path, ["x", "v"], gzip=gz, na=True)
        (part,) = Path(path).glob("part-*")
        data = gzip.decompress(part.read_bytes()) if gz else part.read_bytes()
        assert data.decode() == "x\tv\na\tNA\nb\t0.5\n"
    assert tables.read_tsv(spark, str(folder / "outFalse"), "x string, v string").count() == 2


def test_samples_are_those_of_the_files(spark, folder):
    d = folder / "many"
    d.mkdir()
    (d / "s1.site.tsv").write_text("sample\tn\ns1\t1\n\t2\n")
    (d / "s2.site.tsv").write_text("sample\tn\ns2\t3\n")
    df = tables.checked_samples(tables.read_tsv(spark, str(d), "sample string, n long", provenance=True))
    assert sorted((r["sample"], r["n"]) for r in df.collect()) == [("s1", 1), ("s1", 2), ("s2", 3)]
    (d / "s2.again.tsv").write_text("sample\tn\ns2\t3\n")
    with pytest.raises(Exception, match="two files"):
        tables.checked_samples(tables.read_tsv(spark, str(d), "sample string, n long", provenance=True)).collect()
    (d / "s2.again.tsv").unlink()
    (d / "s3.site.tsv").write_text("sample\tn\ns9\t3\n")
    with pytest.raises(Exception, match="another sample"):
        tables.checked_samples(tables.read_tsv(spark, str(d), "sample string, n long", provenance=True)).collect()


def test_references_of_another_version(spark, folder):
    df = spark.createDataFrame([("snoRNA", "chr1", 1, 2)], "category string, chrom string, start long, end long")
    tables.write_reference({"categories": df}, str(folder / "ref"))
    assert tables.read_reference(spark, str(folder / "ref"), "categories", categories=["snoRNA"]).count() == 1
    with pytest.raises(ValueError, match="lncRNA"):
        tables.read_reference(spark, str(folder / "ref"), "categories", categories=["snoRNA", "lncRNA"])
    with pytest.raises(ValueError, match="lacks gene_id"):
        tables.read_reference(spark, str(folder / "ref"), "categories", schemas.SMALL_NCRNA)


def test_file_order_is_by_name_whatever_the_sizes(spark, tmp_path):
    line = lambda i, n: f"G{i}\tT{n}\t{'x' * 50}\n"
    (tmp_path / "a.tsv").write_text("gene_id\ttranscript_id\tn\n" + line(1, "a"))
    (tmp_path / "b.tsv").write_text("gene_id\ttranscript_id\tn\n" + "".join(line(i, "b") for i in range(5000)))
    found = {r["gene_id"]: r["transcript_id"] for r in tables.read_selected_transcripts(spark, str(tmp_path)).collect()}
    assert found["G1"] == "Ta" and found["G2"] == "Tb"


def test_first_transcript_in_file_order(spark, folder):
    (folder / "t.tsv").write_text("gene_id\ttranscript_id\tn\nG\tT2\t1\nG\tT1\t9\nH\tT3\t1\n")
    assert {tuple(r) for r in tables.read_selected_transcripts(spark, str(folder / "t.tsv")).select("gene_id", "transcript_id").collect()} == {("G", "T2"), ("H", "T3")}
    assert spark.range(1).select(tables.sample_of(F.lit("ILS_1.dedup.bam"))).first()[0] == "ILS_1"
