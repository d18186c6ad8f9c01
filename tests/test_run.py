import csv

import genome
import pytest

from spanforge import run


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    (d / "a.gtf").write_text(genome.GTF)
    (d / "bp.tsv").write_text(genome.BRANCHPOINTS, newline="")
    (d / "s1.dedup.bam").write_bytes(genome.bam_bytes(genome.SAM))
    (d / "s2.dedup.bam").write_bytes(genome.bam_bytes([genome.SAM[1], *[x for f in genome.FRAGMENTS[:2] for x in genome.pair(*f)]]))
    (d / "samples.tsv").write_text("sample\tcondition\ns1\tILS\ns2\tDIS\n")
    (d / "pairs.tsv").write_text("sample\ttotal_input_pairs\tgenome_input_pairs\trrna\tsnrna\ns1\t40\t30\t2\t1\ns2\t10\t5\t0\t0\n")
    (d / "longest.tsv").write_text("gene_id\ttranscript_id\nG1\tT1\nG2\tT2\n")
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    run.run(spark, run.parse(["references", "--gtf", f"{d}/a.gtf", "--branchpoints", f"{d}/bp.tsv", "--out", f"{d}/refs"]))
    yield d
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(folder, name):
    (part,) = (folder / name).glob("part-*")
    return list(csv.DictReader(part.read_text().splitlines(), delimiter="\t"))


def bams(d):
    return ["--alignments", f"{d}/s1.dedup.bam", f"{d}/s2.dedup.bam"]


def test_downstream_from_files(spark, folder):
    run.run(spark, run.parse(["downstream", *bams(folder), "--references", f"{folder}/refs", "--samples", f"{folder}/samples.tsv", "--out", f"{folder}/down"]))
    found = rows(folder / "down", "summary_by_sample")
    assert [(r["sample"], r["condition"], r["reference_introns"]) for r in found] == [("s1", "ILS", "3"), ("s2", "DIS", "3")]
    assert int(found[0]["downstream_exon_spanning_fragments"]) == 1


def test_content_and_branchpoints_from_files(spark, folder):
    run.run(spark, run.parse(["content", *bams(folder), "--references", f"{folder}/refs", "--pairs", f"{folder}/pairs.tsv", "--out", f"{folder}/kinds"]))
    found = rows(folder / "kinds", "rna_content")
    assert sum(int(r["count"]) for r in found if r["sample"] == "s2") == 5 and len(found) == 36
    given = run.parse(["branchpoint", *bams(folder), "--references", f"{folder}/refs", "--samples", f"{folder}/samples.tsv", "--out", f"{folder}/bp"])
    made = run.ANALYSES["branchpoint"][0](spark, given)
    assert {"site_counts", "summary_by_condition", "three_prime_all_by_condition"} <= made.keys()
    assert made["summary"].count() == 2


def test_arguments():
    assert run.parse(["overlap", "--sites", "a", "b", "--conditions", "X", "Y", "--out", "o"]).conditions == ["X", "Y"]
    with pytest.raises(SystemExit):
        run.parse(["premrna", "--out", "o"])
