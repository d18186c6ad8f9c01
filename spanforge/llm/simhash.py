"""Near-duplicates by SimHash fingerprints, found with pigeonring filtering.

A fingerprint of 64 bits is seen as a ring of m segments. If two fingerprints differ in at most t bits in all, then some segment starts a chain around the ring of which every beginning of l segments differs in at most l * t / m bits. With m = 5 and t = 2 the budgets of such a chain are 0, 0, 1, 1, 2 bits: two neighbouring segments agree entirely, the next two differ in one bit together at most. So fingerprints are joined on each pair of neighbouring segments (25 or 26 bits), the pairs found must keep within the budgets of the whole chain, and the full Hamming check follows.

Equal fingerprints are one node. Where more than `bucket` different fingerprints share such a key, pairs aren't listed. There every fingerprint is put under itself and under each string that differs from it in one of the other bits; two fingerprints are within 2 bits if, and only if, they meet under some string, and all that meet there are linked to one of them. That gives the same components from a number of rows that grows with the fingerprints, not with their pairs.

For near copies by similarity, `keep_one_of_similar`, one fingerprint isn't enough: texts that share four fifths of their five-word shingles differ in about ten of 64 bits. There, candidates are texts that agree in a band of min-hashes of their shingles: the chance of it depends on the similarity alone, not on where texts differ. A long fingerprint over the shingles then estimates the similarity of each candidate pair, and is itself looked at as a ring before all of it is counted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .decontam import words as plain_words

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Config:
    shingle: int = 3  # words
    distance: int = 2  # bits
    segments: int = 5
    bucket: int = 64  # fingerprints of a key that are still paired with each other
    seed: int = 42


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Of the whole text; a bit is 1 if more than half of the shingles' hashes have it."""
    words = [w for w in SPACE.split(text.encode("utf-8", "replace").translate(LOWER)) if w]
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]])
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, config: Config = Config(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed long. A null text has no words, and so fingerprint zero."""
    common.prepare(docs.sparkSession)
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, config.shingle, config.seed) for t in common.texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=out)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t")).mapInArrow(apply, "id long, fp long")


def segments(config: Config) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    cuts = [64 * i // config.segments for i in range(config.segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << n) - 1) << a for a, n in parts)


def _bits(col: Column, mask: int) -> Column:
    return F.bit_count(col.bitwiseAND(_long(mask)))


def _chain(config: Config) -> tuple[list[int], int]:
    """The budget of each chain length, and how many first segments must agree entirely."""
    budgets = [length * config.distance // config.segments for length in range(1, config.segments + 1)]
    return budgets, sum(b == 0 for b in budgets)


def links(nodes: DataFrame, config: Config = Config(), rounds: int = 1) -> DataFrame:
    """Links (a, b) between nodes; nodes: (fps, first), one row for each node: its fingerprints, one for each round, as an array, and its name.

    They are the pairs within the distance in any round, or, for nodes in a large bucket, pairs that join the same nodes into components.
    """
    if config.distance != 2 or config.segments < 3:
        raise ValueError("links() is written for a distance of 2")
    ring, (budgets, equal) = segments(config), _chain(config)
    keys = [_mask([ring[(i + j) % len(ring)] for j in range(equal)]) for i in range(len(ring))]
    each = [F.struct(F.lit(r * len(ring) + i).alias("i"), F.get("fps", F.lit(r)).alias("fp"), F.get("fps", F.lit(r)).bitwiseAND(_long(k)).alias("key")) for r in range(rounds) for i, k in enumerate(keys)]
    placed = nodes.select("first", F.explode(F.array(*each)).alias("p")).select("first", "p.i", "p.fp", "p.key")
    sizes = common.cut(placed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    at = F.col("i") % len(ring)

    # Small buckets: pairs, pruned by the budgets around the ring, then by the full distance. No node meets more than `bucket` others under a key.
    small = placed.join(sizes.where(F.col("n") <= config.bucket).select("i", "key"), ["i", "key"], "left_semi")
    left, right = (small.select("i", "key", F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x)) for x in "ab")
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    within = F.lit(False)
    for i in range(len(ring)):
        here = at == i
        for length in range(equal + 1, len(ring) + 1):
            if length == len(ring) or budgets[length - 1] != budgets[length]:
                here &= _bits(differ, _mask([ring[(i + j) % len(ring)] for j in range(length)])) <= budgets[length - 1]
        within |= here
    pairs = left.join(right, ["i", "key"]).where((F.col("a") < F.col("b")) & within).where(F.bit_count(differ) <= config.distance).select("a", "b")

    # Large buckets: all that are within one bit of the same string are linked to one of them.
    large = placed.join(sizes.where(F.col("n") > config.bucket).select("i", "key"), ["i", "key"], "left_semi")
    near = None
    for i, k in enumerate(keys):
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_long(1 << bit)) for bit in range(64) if not k >> bit & 1])
        near = F.when(at == i, flips) if near is None else near.when(at == i, flips)
    under = large.select("first", F.floor(F.col("i") / len(ring)).cast("int").alias("r"), F.explode(near).alias("s"))
    least = under.groupBy("r", "s").agg(F.min("first").alias("a"), F.max("first").alias("z")).where(F.col("a") < F.col("z")).select("r", "s", "a")
    stars = under.join(common.cut(least), ["r", "s"]).where(F.col("a") < F.col("first")).select("a", F.col("first").alias("b"))
    return pairs.unionAll(stars)


def classes(docs: DataFrame, config: Config = Config(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id whose fingerprint can be reached by steps of few bits.

    Repeated ids are rows of their own. A row with a null id has the component of its fingerprint if a row with an id has that too, else null, and links nothing. Other columns aren't read.
    """
    by_id = common.stored(fingerprints(docs, config, id_column, text_column))
    nodes = common.cut(by_id.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(links(nodes.select(F.array("fp").alias("fps"), "first"), config))
    named = nodes.join(linked, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("component"))
    return by_id.join(named, "fp", "left").select(F.col("id").alias(id_column), "fp", "component")


def keep_first(docs: DataFrame, config: Config = Config(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one whose id names the component. Of rows that share that id and its fingerprint one stays; rows with a null id all do."""
    found = classes(docs.where(F.col(id_column).isNotNull()), config, id_column, text_column)
    ids = found.where(F.col(id_column) == F.col("component")).select(id_column).distinct()
    kept = docs.where(F.col(id_column).isNotNull()).join(ids, id_column, "left_semi").dropDuplicates([id_column])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_column).isNull()))


@dataclass(frozen=True)
class Similar:
    """Settings of keep_one_of_similar."""

    shingle: int = 5  # words
    similarity: float = 0.8  # share of all shingles of two texts that both have
    slack: float = 0.05  # how far below that an estimate may be, about two standard errors of it
    lanes: int = 16  # words of 64 bits of a fingerprint
    bucket: int = 256  # texts of a band, not yet in one component, that are compared without more rounds of links to a middle one
    bands: int = 20
    band: int = 4  # min-hashes of a band: all agree by chance similarity ** band
    salt: int = 1000  # texts of a band that a task compares others with

    def bits(self) -> int:
        """Most bits in which the shingles' fingerprints may differ: the angle between sets of that similarity."""
        j = self.similarity - self.slack
        return int(64 * self.lanes * math.acos(2 * j / (1 + j)) / math.pi)


class Sketches:
    """Long fingerprints of texts, and bands of min-hashes, both over shingles."""

    def __init__(self, config: Similar):
        self.config = config
        # each lane mixes a shingle's hash with a number of its own; each odd factor puts a lane in another order
        rng = np.random.default_rng(42)
        self.own = rng.integers(0, (1 << 63) - 1, config.lanes).astype(np.uint64)
        self.odd = rng.integers(1 << 62, (1 << 63) - 1, -(-config.bands * config.band // config.lanes)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def lanes(self, hashes: np.ndarray) -> np.ndarray:
        """Independent 64-bit numbers of each hash, a column for each lane: the finaliser of splitmix64."""
        z = hashes[:, None] + self.own
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def banded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(bands of min-hashes, fingerprint), as 64-bit integers. Long texts go through in parts."""
        hashes = self.shingles(plain_words(text) or [b""])
        counts, least = 0, None
        for at in range(0, len(hashes), 1 << 12):
            lanes = self.lanes(hashes[at : at + (1 << 12)])
            counts = counts + np.unpackbits(lanes.view(np.uint8), axis=1).sum(0, dtype=np.int64)
            now = np.stack([(lanes * m).min(0) for m in self.odd])
            least = now if least is None else np.minimum(least, now)
        each = least.reshape(-1)[: self.config.bands * self.config.band].reshape(self.config.bands, -1)
        bands = np.array([xxhash.xxh64_intdigest(x.tobytes(), self.config.band) for x in each], np.uint64).view(np.int64)
        return bands, np.packbits(counts * 2 > len(hashes)).view(np.int64)

    def shingles(self, found: list[bytes]) -> np.ndarray:
        """Hashes of the different shingles."""
        k = self.config.shingle
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-k]]).tolist() if len(found) > k else [0]
        stops = (ends[k - 1 :] - 1).tolist() if len(found) > k else [len(joined)]
        digest = xxhash.xxh64_intdigest
        return np.fromiter({digest(joined[a:b], 7) for a, b in zip(starts, stops)}, np.uint64)


#: Columns that marked() adds.
NODE, BANDS, SKETCH, ID = "__spanforge_node", "__spanforge_bands", "__spanforge_sketch", "__spanforge_id"


def marked(docs: DataFrame, config: Similar = Similar(), text_column: str = "text") -> DataFrame:
    """docs with the bands and the fingerprint of each text, and a name of both: texts of one name are one node, whatever their ids."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index(text_column)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema.fields, T.StructField(NODE, T.LongType()), T.StructField(BANDS, longs), T.StructField(SKETCH, longs)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(config)
        for batch in batches:
            found = [sketches.banded(t) for t in common.texts(batch.column(at))]
            names = [xxhash.xxh64_intdigest(b.tobytes() + s.tobytes()) for b, s in found]
            added = [pa.array([_signed(x) for x in names], pa.int64()), *(pa.array([f[i].tolist() for f in found], pa.list_(pa.int64())) for i in range(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, NODE, BANDS, SKETCH])

    return docs.mapInArrow(apply, schema)


def _near(a: str, b: str, config: Similar) -> Column:
    """Whether the fingerprints in columns a0, a1, ... and b0, b1, ... are near enough.

    Their words are a ring. There must be a word from which chains of one to four words differ in no more than their share of the budget; then all are counted.
    """
    n, budget = config.lanes, config.bits()
    differ = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(n)]
    chain = F.lit(False)
    for start in range(n):
        here, total = F.lit(True), F.lit(0)
        for length in range(1, 5):
            total = total + differ[(start + length - 1) % n]
            here &= total * n <= length * budget
        chain |= here
    return chain & (sum(differ[1:], differ[0]) <= budget)


def _sketches(nodes: DataFrame, name: str, config: Similar) -> DataFrame:
    return nodes.select(F.col("first").alias(name), *[F.get("s", F.lit(k)).alias(f"{name}{k}") for k in range(config.lanes)])


def similar(nodes: DataFrame, candidates: DataFrame, config: Similar) -> DataFrame:
    """The candidate pairs (a, b) whose shingles' fingerprints are near enough."""
    both = candidates.distinct().join(_sketches(nodes, "a", config), "a").join(_sketches(nodes, "b", config), "b")
    return both.where(_near("a", "b", config)).select("a", "b")


def joined(nodes: DataFrame, config: Similar) -> DataFrame:
    """(node, component) of each node that has a similar one: the components of all similar pairs that share a band.

    Pairs aren't all compared, as those already in one component needn't be: in each band, all are first compared with a middle one, the one with most company in all its bands. Then every text outside a band's largest component is compared with all of other components; the comparison is part of the join, so only links come out of it. A band of many texts is dealt over several tasks.
    """
    placed = common.stored(nodes.select("first", F.posexplode("bands").alias("r", "key")))
    sizes = placed.groupBy("r", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = common.stored(placed.join(sizes, ["r", "key"]))
    parts = common.parts(shared.count())
    members = common.stored(shared.join(shared.groupBy("first").agg(F.sum("n").alias("weight")), "first").select("r", "key", "n", "first", "weight", F.col("first").alias("component"), F.lit(False).alias("largest")), parts)
    found = None
    for turn in range(3):
        order = F.struct("weight", "first") if not turn else F.struct(F.xxhash64("first", F.lit(turn)), "first")
        middle = members.groupBy("r", "key").agg(F.max_by(F.struct("first", "component"), order).alias("m"))
        stars = members.join(middle, ["r", "key"]).where(F.col("component") != F.col("m.component"))
        pairs = similar(nodes, stars.select(F.least("first", "m.first").alias("a"), F.greatest("first", "m.first").alias("b")), config)
        found = common.stored(pairs if found is None else found.unionAll(pairs), parts)
        linked = components(found)
        members, most = _apart(members, linked, parts)
        if not most:
            return linked
        if most <= config.bucket:
            break
    # The largest component of a band isn't compared with itself, however many it has.
    salts = (F.col("n") / F.lit(config.salt)).cast("int") + 1
    left = members.where(~F.col("largest")).join(_sketches(nodes, "a", config).withColumnRenamed("a", "first"), "first").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    left = left.select("r", "key", "salt", F.col("first").alias("a"), F.col("component").alias("c"), *[f"a{k}" for k in range(config.lanes)])
    right = members.join(_sketches(nodes, "b", config).withColumnRenamed("b", "first"), "first").withColumn("salt", F.pmod(F.xxhash64("first"), salts).cast("int"))
    right = right.select("r", "key", "salt", F.col("first").alias("b"), F.col("component").alias("d"), "largest", *[f"b{k}" for k in range(config.lanes)])
    on = (left["r"] == right["r"]) & (left["key"] == right["key"]) & (left["salt"] == right["salt"]) & (F.col("c") != F.col("d")) & (F.col("largest") | (F.col("a") < F.col("b")))
    rest = left.join(right, on & _near("a", "b", config)).select("a", "b")
    return components(found.unionAll(rest))


def _apart(members: DataFrame, linked: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """The members of bands that aren't in one component yet, and how many such a band has at most outside its largest component."""
    named = common.stored(members.drop("component", "largest").join(linked.select(F.col("node").alias("first"), "component"), "first", "left").withColumn("component", F.coalesce("component", "first")), parts)
    sizes = named.groupBy("r", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = common.stored(sizes.groupBy("r", "key").agg(F.max_by("component", F.struct("n", "component")).alias("c"), (F.sum("n") - F.max("n")).alias("others")).where(F.col("others") > 0), parts)
    most = several.agg(F.max("others")).first()[0] or 0
    return common.stored(named.join(several, ["r", "key"]).select("r", "key", "n", "first", "weight", "component", (F.col("component") == F.col("c")).alias("largest")), parts), most


def keep_one_of_similar(docs: DataFrame, config: Similar = Similar(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of similar texts, with all columns: the one with the smallest id. Rows with a null id all stay, and link nothing.

    Groups are the components of all similar pairs that share a band, however many texts a band has. They are groups of texts, not of ids: different texts under one id are judged apart, and of rows with the same id and text one stays. Null and empty texts are similar to each other and to nothing else. Texts of any length are read whole. An empty table stays empty.
    """
    rows = common.stored(marked(docs, config, text_column))
    with_id = rows.where(F.col(id_column).isNotNull())
    slim = common.stored(with_id.groupBy(NODE, F.col(id_column).alias(ID)).agg(F.count(F.lit(1)).alias("n")))
    nodes = common.stored(with_id.groupBy(F.col(NODE).alias("first")).agg(F.first(BANDS).alias("bands"), F.first(SKETCH).alias("s")))
    linked = joined(nodes, config).select(F.col("node").alias(NODE), "component")
    grouped = slim.join(linked, NODE, "left").withColumn("component", F.coalesce("component", NODE))
    order = F.struct(ID, NODE)
    least = grouped.groupBy("component").agg(F.min(order).alias("least"))
    # what goes, and what stays but stands in several rows
    odd = grouped.join(least, "component").withColumn("goes", order != F.col("least")).where(F.col("goes") | (F.col("n") > 1))
    odd = common.stored(odd.select(F.col(NODE).alias("__spanforge_k"), ID, "goes"))
    if odd.count() <= _BROADCAST_ROWS:
        odd = F.broadcast(odd)
    same = (F.col(NODE) == F.col("__spanforge_k")) & (F.col(id_column) == F.col(ID))
    single = rows.join(odd, same, "left_anti").select(*docs.columns)
    several = rows.join(odd.where(~F.col("goes")), same).dropDuplicates([NODE, ID]).select(*[rows[c] for c in docs.columns])
    return single.unionAll(several)


#: Names and ids of rows that are broadcast to find them, some 16 bytes each; more are joined by a shuffle.
_BROADCAST_ROWS = 1_000_000


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
