"""Annotation attributes, names and regions as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gene types of small RNAs, as normalised, and their names.
SMALL_RNA = {
    "snorna": "snoRNA",
    "scarna": "scaRNA",
    "mirna": "miRNA",
    "trna": "tRNA",
    "ribozyme": "ribozyme",
    "vaultrna": "vaultRNA",
    "vault_rna": "vaultRNA",
    "misc_rna": "misc_RNA",
    "snrna": "snRNA",
}

#: Gene types that count as long non-coding, as normalised.
LONG_NONCODING = ("lncrna", "lincrna", "antisense", "sense_intronic", "sense_overlapping", "processed_transcript", "3prime_overlapping_ncrna", "macro_lncrna", "non_coding", "bidirectional_promoter_lncrna")


def gtf_attributes(col: Column, or_equals: bool = False) -> Column:
    """Attributes as a map; the last of equal keys wins. or_equals: fields with "=" are split there (GFF3), the others at the first space."""
    fields = F.filter(F.transform(F.split(col, ";"), lambda x: F.trim(x)), lambda x: x != "")

    def entry(x: Column) -> Column:
        at = F.locate(" ", x)
        if or_equals:
            at = F.when(F.locate("=", x) > 0, F.locate("=", x)).otherwise(at)
        key = F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x)
        value = F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise("")
        return F.struct(key.alias("key"), F.regexp_replace(F.trim(value), '^"+|"+$', "").alias("value"))

    entries = F.transform(fields, entry)
    # The first of each key, read from the end.
    back = F.reverse(entries)
    last = F.filter(back, lambda x, i: ~F.exists(F.slice(back, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def gtf_attribute(col: Column, key: str) -> Column:
    """One quoted attribute, without making the map; the last of equal keys. Null if it isn't there."""
    found = F.regexp_extract_all(col, F.lit(rf'(?:^|;)\s*{re.escape(key)} +"([^"]*)"'), F.lit(1))
    return F.element_at(F.when(F.size(found) > 0, found), -1)


def has_tag(col: Column, tag: str) -> Column:
    """Tags repeat, so they are looked for in the text."""
    return col.contains(f'tag "{tag}"')


def normalised_type(col: Column) -> Column:
    return F.translate(F.lower(col), "- ", "__")


def _looked_up(normalised: Column, names: dict[str, str]) -> Column:
    """One lookup, so that what the name is made of is worked out once."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), normalised)


def small_rna_category(normalised: Column) -> Column:
    return _looked_up(normalised, SMALL_RNA)


def gene_category(normalised: Column) -> Column:
    """protein_coding, a small RNA, lncRNA, pseudogene, or null."""
    names = {"protein_coding": "protein_coding"} | SMALL_RNA | dict.fromkeys(LONG_NONCODING, "lncRNA")
    return F.coalesce(_looked_up(normalised, names), F.when(normalised.contains("pseudogene"), "pseudogene"))


def region(col: Column) -> Column:
    """struct<chrom, start, end, label> of "chr1:1,000-2,000"; "chr" is put before a bare name. Null if it is no region, starts below 1 or ends before its start."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    bare = F.regexp_replace(col, ",", "")
    chrom = F.regexp_extract(bare, pattern, 1)
    start, end = (F.when(chrom != "", F.regexp_extract(bare, pattern, i)).cast("long") for i in (2, 3))
    named = F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
    label = F.concat(named, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when((start >= 1) & (end >= start), F.struct(named.alias("chrom"), start.alias("start"), end.alias("end"), label.alias("label")))


def chromosome_label(col: Column) -> Column:
    return F.concat(F.lit("chromosome "), F.regexp_replace(col, "^chr", ""))


def file_safe(col: Column) -> Column:
    """A name with only letters, digits and single underscores between them."""
    return F.regexp_replace(F.regexp_replace(col, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
