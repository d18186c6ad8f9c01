"""BAM, FASTQ and FASTA as data sources.

    register(spark)
    spark.read.format("bam").option("sample", "s1").load("a.bam")

A record of these formats can't be found from the middle of a file. Where a BAM file has an index beside it (a.bam.bai or a.bai), which tells where some records begin, it is cut there into partitions of about splitBytes packed bytes, and of a region only the parts that may hold it are read:

    spark.read.format("bam").option("region", "chr1:1,000-2,000").load("a.bam")

Otherwise a file is one partition; land large ones as Parquet, by sample and sorted by place, and read that from then on. Paths may be globs or lists joined by commas; those with a scheme are opened by Arrow's file systems.
"""

from __future__ import annotations

import glob
import gzip
import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanforge import schemas

_OPERATIONS = "MIDNSHP=X"
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def open_raw(path: str):
    """The bytes of a file as they are stored."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return io.BufferedReader(system.open_input_file(inner))
    return open(path.removeprefix("file:"), "rb")


def open_bytes(path: str) -> io.BufferedIOBase:
    """Unpacked bytes of a file, gzip or not; blocks of gzip (BGZF) are read one after the other."""
    raw = open_raw(path)
    packed = raw.peek(2)[:2] == b"\x1f\x8b"
    return gzip.GzipFile(fileobj=raw) if packed else raw


class Blocks:
    """A BGZF file from a virtual offset on: the place of a packed block, times 65,536, plus the place in it once unpacked."""

    def __init__(self, raw, offset: int):
        self.raw = raw
        self.next = offset >> 16
        self.here, self.data, self.at = self.next, b"", 0
        self._load()
        self.at = offset & 0xFFFF

    def _load(self) -> bool:
        self.raw.seek(self.next)
        head = self.raw.read(12)
        if len(head) < 12:
            self.here, self.data, self.at = self.next, b"", 0
            return False
        extra = self.raw.read(struct.unpack_from("<H", head, 10)[0])
        at = size = 0
        while at < len(extra):
            mark, length = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if mark == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + length
        if not size:
            raise ValueError("not a BGZF file")
        self.data = zlib.decompress(self.raw.read(size - 12 - len(extra) - 8), -15)
        self.here, self.next, self.at = self.next, self.next + size, 0
        return True

    def tell(self) -> int:
        """Of the next byte. The end of a block is the beginning of the next."""
        return self.next << 16 if self.at >= len(self.data) else self.here << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at >= len(self.data):
                if not self._load():
                    break
                continue
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


@dataclass
class BamIndex:
    """Of a BAM file: for each reference its chunks by bin, and where the first record of each 16,384 bases begins."""

    chunks: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)

    @staticmethod
    def read(data: bytes) -> BamIndex:
        if data[:4] != b"BAI\x01":
            raise ValueError("not a BAM index")
        out, at = BamIndex(), 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins: dict[int, list[tuple[int, int]]] = {}
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                number, m = struct.unpack_from("<Ii", data, at)
                bins[number] = [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(m)]
                at += 8 + 16 * m
            (n,) = struct.unpack_from("<i", data, at)
            out.chunks.append(bins)
            out.linear.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n
        return out

    def cuts(self, first: int, size: int) -> list[int]:
        """Places where records begin, each about so many packed bytes after the one before; the first record is at first."""
        places = sorted({v for of in self.linear for v in of if v > first} | {a for of in self.chunks for n, cs in of.items() if n < 37450 for a, _ in cs if a > first})
        out = [first]
        for v in places:
            if (v >> 16) - (out[-1] >> 16) >= size:
                out.append(v)
        return out

    def region(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Parts of the file that may hold records about [start, end), from 0, joined where they overlap."""
        if not 0 <= ref < len(self.chunks):
            return []
        linear = self.linear[ref]
        least = linear[start >> 14] if start >> 14 < len(linear) else linear[-1] if linear else 0
        found = []
        # bins of 2^29 bases down to 2^14, eight to one
        for level in range(6):
            first, shift = ((1 << 3 * level) - 1) // 7, 29 - 3 * level
            for number in range(first + (start >> shift), first + ((end - 1) >> shift) + 1):
                found += [(max(a, least), b) for a, b in self.chunks[ref].get(number, ()) if b > least]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[_File]:
        paths = [p for part in self.options["path"].split(",") for p in (sorted(glob.glob(part)) or [part])]
        return [_File(p) for p in paths]

    def sample(self, path: str) -> str:
        return self.options.get("sample") or path.rsplit("/", 1)[-1].split(".")[0]


class _Part(_File):
    """Records that begin at virtual offsets in [start, stop); stop None: to the end. start None: a file that is read from its beginning."""

    def __init__(self, path: str, start: int | None = None, stop: int | None = None):
        super().__init__(path)
        self.start, self.stop = start, stop


def _index(path: str) -> BamIndex | None:
    for name in (f"{path}.bai", re.sub(r"\.bam$", ".bai", path)):
        try:
            with open_raw(name) as f:
                return BamIndex.read(f.read())
        except FileNotFoundError:
            continue
    return None


def _region(text: str) -> tuple[str, int, int] | None:
    """(reference, first base, last base) of "chr1:1,000-2,000" or of a name alone."""
    if not text:
        return None
    m = re.fullmatch(r"(.+):(\d+)-(\d+)", text.replace(",", ""))
    return (m[1], int(m[2]), int(m[3])) if m else (text, 1, 1 << 29)


class BamReader(_Reader):
    def partitions(self) -> list[_File]:
        size, region = int(self.options.get("splitbytes") or self.options.get("splitBytes") or 64 << 20), _region(self.options.get("region", ""))
        out: list[_File] = []
        for part in super().partitions():
            index = _index(part.path)
            if index is None:
                out.append(_Part(part.path))
                continue
            with open_raw(part.path) as raw:
                blocks = Blocks(raw, 0)
                names = bam_header(blocks)
                first = blocks.tell()
            if region is None:
                cuts = index.cuts(first, size)
                out += [_Part(part.path, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
            elif region[0] in names:
                out += [_Part(part.path, a, b) for a, b in index.region(names.index(region[0]), region[1] - 1, region[2])]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition is None:  # Spark's way to read what has no partition
            return
        sample, region = self.sample(partition.path), _region(self.options.get("region", ""))
        if partition.start is None:
            with open_bytes(partition.path) as f:
                rows = bam_records(f, bam_header(f), sample)
                yield from (r for r in rows if region is None or _touches(r, region))
            return
        with open_raw(partition.path) as raw:
            names = bam_header(Blocks(raw, 0))
            blocks = Blocks(raw, partition.start)
            rows = bam_records(blocks, names, sample, lambda: partition.stop is not None and blocks.tell() >= partition.stop)
            yield from (r for r in rows if region is None or _touches(r, region))


def _touches(row: tuple, region: tuple[str, int, int]) -> bool:
    name, start, end = region
    _, _, _, rname, pos, _, cigar = row[:7]
    if rname != name or pos > end:
        return False
    reach = sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "") if op in "MDN=X")
    return pos + max(reach, 1) - 1 >= start


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the BAM file ends inside a record")
    return data


def bam_header(f) -> list[str]:
    """Names of the references; f then stands at the first record."""
    if _exactly(f, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    _exactly(f, struct.unpack("<i", _exactly(f, 4))[0])
    names = []
    for _ in range(struct.unpack("<i", _exactly(f, 4))[0]):
        names.append(_exactly(f, struct.unpack("<i", _exactly(f, 4))[0])[:-1].decode())
        _exactly(f, 4)
    return names


def bam_records(f, names: list[str], sample: str, ended=lambda: False) -> Iterator[tuple]:
    name = lambda i: names[i] if i >= 0 else None
    while not ended() and (head := f.read(4)):
        data = _exactly(f, struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32 + n_name
        ops = struct.unpack_from(f"<{n_cigar}I", data, at)
        at += 4 * n_cigar + (n_seq + 1) // 2 + n_seq
        cigar = "".join(f"{x >> 4}{_OPERATIONS[x & 15]}" for x in ops) or None
        yield (sample, data[32 : 32 + n_name - 1].decode(), flag, name(ref), pos + 1, mapq, cigar, name(next_ref), next_pos + 1, tlen, _integer_tag(data, at, b"NH"))


def _integer_tag(data: bytes, at: int, wanted: bytes) -> int | None:
    while at < len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            (n,) = struct.unpack_from("<i", data, at + 1)
            at += 5 + n * _TAG_SIZES[chr(data[at])]
        else:
            if tag == wanted and kind in _TAG_FORMATS:
                return struct.unpack_from(_TAG_FORMATS[kind], data, at)[0]
            at += _TAG_SIZES[kind]
    return None


class FastqReader(_Reader):
    def read(self, partition: _File) -> Iterator[tuple]:
        with open_bytes(partition.path) as f:
            lines = (line.rstrip(b"\r\n").decode("utf-8", "replace") for line in io.BufferedReader(f))
            for i, name in enumerate(lines):
                yield (i, name.removeprefix("@"), next(lines, ""), (next(lines, ""), next(lines, ""))[1])


class FastaReader(_Reader):
    def read(self, partition: _File) -> Iterator[tuple]:
        with open_bytes(partition.path) as f:
            name, parts, n = None, [], 0
            for line in io.BufferedReader(f):
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.startswith(">"):
                    if name is not None:
                        yield (n, name, "".join(parts))
                        n += 1
                    name, parts = text[1:], []
                else:
                    parts.append(text)
            if name is not None:
                yield (n, name, "".join(parts))


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return schemas.ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self):
        return schemas.FASTQ

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self):
        return schemas.FASTA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (Bam, Fastq, Fasta):
        spark.dataSource.register(source)


def count_fastq(spark: SparkSession, path: str) -> int:
    """Records of a FASTQ file, from its lines; splits don't matter for a count."""
    return spark.read.text(path).count() // 4
