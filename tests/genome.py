"""Small annotation and alignments, with results worked out by hand."""

import gzip
import struct

GTF = """#comment
chr1\tt\ttranscript\t101\t600\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_type "protein_coding"; gene_name "One"; tag "basic"; tag "MANE_Select";
chr1\tt\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_type "protein_coding"; gene_name "One"; tag "MANE_Select"; tag "x";
chr1\tt\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_type "protein_coding"; gene_name "One"; tag "MANE_Select";
chr1\tt\texon\t501\t600\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_type "protein_coding"; gene_name "One"; tag "MANE_Select";
chr1\tt\tgene\t101\t600\t.\t+\t.\tgene_id "G1"; gene_type "protein_coding"; gene_name "One";
chr1\tt\ttranscript\t1001\t1300\t.\t-\t.\tgene_id "G2"; transcript_id "T2"; gene_type "protein_coding"; tag "MANE_Select";
chr1\tt\texon\t1001\t1100\t.\t-\t.\tgene_id "G2"; transcript_id "T2"; gene_type "protein_coding"; tag "MANE_Select";
chr1\tt\texon\t1201\t1300\t.\t-\t.\tgene_id "G2"; transcript_id "T2"; gene_type "protein_coding"; tag "MANE_Select";
chr1\tt\tgene\t1001\t1300\t.\t-\t.\tgene_id "G2"; gene_type "protein_coding";
chr1\tt\tgene\t340\t345\t.\t+\t.\tgene_id "S1"; gene_type "snoRNA"; gene_name "sno";
chr1\tt\tgene\t2001\t2100\t.\t+\t.\tgene_id "L1"; gene_biotype "lincRNA";
chr1\tt\tgene\t2050\t2200\t.\t-\t.\tgene_id "X1"; gene_type "TEC";
too\tfew\tfields
"""

BRANCHPOINTS = "chr\tstart\tstrand\tscore\tintron_type\r\nchr1\t275\t+\t0.9\tU2\r\nchr1\t280\t+\t0.9\tU2\r\nchr1\t470\t+\t0.4\tU2\r\nchr1\t1125\t-\t0.7\tU12\r\nchr1\t700\t+\t0.5\tU2\r\n"


def sam_line(qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, nh=None):
    return "\t".join(map(str, (qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, "*", "*"))) + (f"\tNM:i:0\tNH:i:{nh}" if nh is not None else "")


def pair(name, strand, five, three, **more):
    """A proper pair of ten-base reads with the given ends."""
    if strand == "+":
        length = three - five + 1
        return [sam_line(name, 99, "chr1", five, 60, "10M", "=", three - 9, length, 1), sam_line(name, 147, "chr1", three - 9, 60, more.get("mate", "10M"), "=", five, -length, 1)]
    length = five - three + 1
    return [sam_line(name, 83, "chr1", five - 9, 60, "10M", "=", three, -length, 1), sam_line(name, 163, "chr1", three, 60, more.get("mate", "10M"), "=", five - 9, length, 1)]


#: Fragments by their ends; what becomes of each is in test_plans.
FRAGMENTS = [("f1", "+", 280, 298), ("f2", "+", 281, 301), ("f3", "+", 250, 302), ("f4", "+", 150, 295), ("f5", "-", 1125, 1100), ("f6", "+", 260, 310)]

SAM = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:5000", *[x for f in FRAGMENTS for x in pair(*f)]]
#: Pairs that are filtered: one for each reason.
SAM += pair("spliced", "+", 282, 300, mate="5M100N5M")
SAM += [sam_line("unmapped", 77, "*", 0, 0, "*", "*", 0, 0), sam_line("unmapped", 141, "*", 0, 0, "*", "*", 0, 0)]
SAM += [sam_line("improper", 65, "chr1", 280, 60, "10M", "=", 290, 20, 1), sam_line("improper", 129, "chr1", 290, 60, "10M", "=", 280, -20, 1)]
SAM += [x.replace("NH:i:1", "NH:i:3") for x in pair("multi", "+", 280, 299)]
SAM += [sam_line("no_end", 99, "chr1", 280, 60, "10M", "=", 290, 0, 1), sam_line("no_end", 147, "chr1", 290, 60, "10M", "=", 280, 0, 1)]
SAM += [sam_line("no_mate", 99, "chr1", 280, 60, "10M", "=", 290, 20)]
SAM += [sam_line("f1", 355, "chr1", 700, 0, "10M", "=", 800, 110, 2)]  # a secondary record of a good fragment


def bam_bytes(sam_lines):
    """BAM of SAM lines, in two gzip members."""
    names = [x.split("SN:")[1].split("\t")[0] for x in sam_lines if x.startswith("@SQ")]
    text = "\n".join(x for x in sam_lines if x.startswith("@")).encode() + b"\n"
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 5000)
    cut = len(out)
    for line in (x for x in sam_lines if not x.startswith("@")):
        f = line.split("\t")
        ops, number = [], ""
        for c in "" if f[5] == "*" else f[5]:
            if c.isdigit():
                number += c
            else:
                ops.append(int(number) << 4 | "MIDNSHP=X".index(c))
                number = ""
        ref = names.index(f[2]) if f[2] in names else -1
        mate = ref if f[6] == "=" else names.index(f[6]) if f[6] in names else -1
        name = f[0].encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(name), int(f[4]), 0, len(ops), int(f[1]), 3, mate, int(f[7]) - 1, int(f[8]))
        body += name + struct.pack(f"<{len(ops)}I", *ops) + b"\x12\x40" + b"\xff\xff\xff"
        body += b"XAZtext\0" + b"XBBs" + struct.pack("<i2h", 2, 1, 2)
        for tag in f[11:]:
            key, _, value = tag.split(":")
            body += key.encode() + b"C" + struct.pack("<B", int(value))
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out[:cut]) + gzip.compress(out[cut:])


