"""Near duplicates by circulant MinHash, banding and exact verification.

A document's set are the 64-bit hashes of its distinct word shingles (two different shingles in a
pair of documents of n each have one hash with a chance of n^2 / 2^64). One permutation of the
32-bit universe places the shingles; a second one, circularly shifted by k = 0, 1, ..., gives the
k-th signature coordinate as the least image of the set. Two permutations so replace hundreds. The
coordinates are cut into bands, and documents that share a band are candidates; the number of bands
is chosen so that a pair at the threshold is missed with a chance below MISS. Every link rests on
the full sets of both documents: 100 * intersection >= percent * union.

Large groups. Documents of equal sets are one node from the start. In each band bucket the members
are verified against one leader only (a star): the member that shares the most bands with others,
as the text that the others were copied from does, so that the star joins most of a group of
copies. Buckets whose other members then still lie in several components get an exact search among
these members: pairs of different components are verified if the places of their rare common
shingles still allow the threshold (prefix and positional filtering, with frequencies within these
nodes, and shingles of one component only counted as lost). No bucket is capped and no pair at the
threshold among candidates is lost, yet a group of m copies yields about m comparisons.

Plan. The first pass writes, per document, the set's size, a 128-bit fingerprint and the bands, not
the set. Band rows are (band, node, size), counted map-side; texts of candidates alone are read
again for their sets. Tables that later steps meet again are written; joins with them are
broadcast only under Spark's size limit and may be split by adaptive execution where a key is hot.
Components come by repeated least-neighbour steps with pointer jumping, on links only.

Defined results. Words are runs of characters other than space, \\t, \\n, \\v, \\f, \\r, with A-Z in
lower case. With fewer words than a shingle has, the whole sequence is the one shingle; a null text
or one without words has an empty set and no links. component_id is the least doc_id reachable,
nulls last; kept says that doc_id equals it, so rows that share both a doc_id and a component are
kept alike. Very long texts are read whole. Repeated rows are one node; of them, and of all rows of a
component, stays is true for the one with the least doc_id, then the least row. An empty table gives
an empty result. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import free, materialise, table

WORDS, PERCENT, ROWS, MISS, CACHE_WORDS = 5, 80, 5, 1e-6, 300_000


def n_bands(percent: int, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes, and signatures of them."""

    def __init__(self, words: int, bands: int, rows: int):
        self.size, self.bands, self.rows = words, bands, rows
        self.hashes: dict[bytes, int] = {}
        odd = np.array([xxhash.xxh64_intdigest(b"w%d" % i) | 1 for i in range(max(words, rows))], np.uint64)
        self.by_place, self.by_row = odd[:words], odd[:rows]
        self.shifts = np.arange(bands * rows, dtype=np.uint32)[:, None]
        self.band_seed = np.array([xxhash.xxh64_intdigest(b"b%d" % i) for i in range(bands)], np.uint64)

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(28))

    def set_of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.hashes
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        if len(h) < self.size:
            return np.array([xxhash.xxh64_intdigest(h.tobytes(), 1)], np.uint64)
        n = len(h) - self.size + 1
        key = np.zeros(n, np.uint64)
        for i in range(self.size):
            key += h[i : i + n] * self.by_place[i]
        return np.unique(self._mixed(key))

    def signature(self, found: np.ndarray) -> np.ndarray:
        """The least image of the placed set under the second permutation, for each circular shift."""
        placed = (self._mixed(found * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(placed), 1024):
            x = placed[i : i + 1024] - self.shifts
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x297A2D39)
            np.minimum(best, x.min(1), out=best)
        return best

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        rows = (signature.astype(np.uint64).reshape(self.bands, self.rows) + np.uint64(1)) * self.by_row
        return self._mixed(self._mixed(rows.sum(1, dtype=np.uint64)) ^ self.band_seed).view(np.int64)


def _fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sign(words: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("given", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingler.set_of(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
                keys = [shingler.band_keys(shingler.signature(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), part.column(3),
                ], schema=schema)

    return run


def _sets(words: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, 1, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                nodes, sets = [], []
                for node, set_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    found = shingler.set_of(text or b"")
                    if _fingerprint(found) == set_id:  # else another text of the same doc_id and hash
                        nodes.append(node)
                        sets.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that the links (a, b) reach, for every node with a link. links is read again and again."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        before = labels
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        stepped = materialise(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("next")), "step")
        jump = stepped.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = materialise(stepped.join(jump, "next").select("node", "was", F.least("next", "far").alias("component")), "labels")
        free(before, stepped)
        labels = after.select("node", "component")
        labels._driftline_path = after._driftline_path
        if after.filter("component <> was").isEmpty():
            free(both)
            return labels


def _near_sizes(percent: int, x: str = "na", y: str = "nb"):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b), on full sets. The member's set is fetched first, so a hot leader's rows may be split."""
    one = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    common = pairs.join(one, "b").join(two, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))
    return common.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _of_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _cross_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that may be linked, among mixed (node, component).

    A node's shingles stand in one order: first the dead ones, which no other component has, then
    the others from rare to frequent, ties by value. With d dead ones a set of n shares n - d with
    a set of another component at most. A pair needs `need` common shingles, so the first of them
    stands at na - need or before in one set and at nb - need or before in the other (from 0). All
    common shingles up to there are joined, and are the first ones of the pair's common shingles;
    what may follow is bounded by the shorter rest behind the last of them.
    """
    own = materialise(mixed.join(sets, "node").select("node", "component", "n", F.explode("shingles").alias("shingle")).repartition("shingle"), "shingles")
    often = materialise(own.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle", "often"), "often")
    live = own.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("live"))
    least = F.expr(f"({percent} * n + 99) div 100")  # in the smallest set that may be linked with one of n
    sized = mixed.join(sets.select("node", "n"), "node").join(live, "node").withColumns({"dead": (F.col("n") - F.size("live")).cast("long"), "least": least})
    possible = sized.filter((100 + percent) * F.size("live") >= percent * (F.col("n") + F.col("least")))
    first = F.transform(F.slice("live", F.lit(1), F.greatest(F.lit(0), F.col("n") - F.col("least") + 1 - F.col("dead")).cast("int")), lambda s: s["shingle"])
    placed = possible.select("node", "component", "n", "dead", F.posexplode(first).alias("at", "shingle"))
    prefix = materialise(placed.select("node", "component", "n", "dead", "shingle", (F.col("dead") + F.col("at")).alias("at")), "prefix")
    # The larger set (by node if equal) is a; the smaller needs the first n - 2 percent n / (100 + percent) shingles only.
    left = prefix.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "component", "n", "dead", "at")))
    right = prefix.filter(f"(100 + {percent}) * at <= (100 - {percent}) * n").select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "dead", "at")))
    need = f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"
    larger = F.expr("component_a <> component_b AND (n_a > n_b OR n_a = n_b AND node_a > node_b)")
    may = larger & _near_sizes(percent, "n_a", "n_b") & F.expr(" AND ".join(f"n_{x} - greatest(dead_{x}, at_{x}) >= {need}" for x in "ab"))
    common = left.withColumnRenamed("shingle", "shingle_a").join(right, (F.col("shingle_a") == F.col("shingle")) & may)
    pairs = common.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("both"), F.max("at_a").alias("last_a"), F.max("at_b").alias("last_b"))
    found = materialise(pairs.filter(f"both + least(n_a - 1 - last_a, n_b - 1 - last_b) >= {need}").select("a", "b"), "pairs")
    free(own, often, prefix)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row, stays: one row per row of docs.

    row names the rows: the values of the column that is given as row, or numbers of this run's own.
    stays is true for one row of each component.
    """
    bands = n_bands(percent, rows, miss)
    # Null and repeated doc_ids are told apart by a hash of the text, which has no say in the links.
    read = docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text", f"cast({f'`{row}`' if row else 'null'} as bigint) given")
    ddl = "doc_id bigint, text_hash bigint, n bigint, set_id binary, bands array<bigint>, given bigint"
    signed = read.select("doc_id", "text_hash", "text", "given").mapInArrow(_sign(words, bands, rows), ddl)
    signed = materialise(signed.withColumn("row", F.col("given") if row else F.monotonically_increasing_id()).drop("given"), "signed")
    same = materialise(signed.filter("n > 0").groupBy("set_id").agg(F.min("row").alias("node"), F.count("*").alias("copies")).filter("copies > 1").select("set_id", "node"), "same")
    noded = signed.join(same, "set_id", "left").withColumn("node", F.coalesce("node", "row"))
    nodes = noded.filter("n > 0 AND node = row")

    band_rows = nodes.select(F.explode("bands").alias("band"), "node", "n")
    shared = materialise(band_rows.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    found = materialise(band_rows.join(shared, "band"), "found")
    central = materialise(found.groupBy("node").agg(F.sum("members").alias("weight")), "central")
    weighed = found.join(central, "node")
    leaders = materialise(weighed.groupBy("band").agg(F.max(F.struct("weight", -F.col("node"), "n", "node")).alias("leader")).select("band", "leader.node", "leader.n").toDF("band", "leader", "leader_n"), "leaders")
    members = materialise(found.join(leaders, "band").select("band", "node", "n", "leader", "leader_n"), "members")
    free(shared, found, central, leaders)
    wanted = materialise(members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash", "set_id"), "node"), "wanted")
    its = (wanted["doc_id"].eqNullSafe(read["doc_id"])) & (wanted["text_hash"] == read["text_hash"])
    # The texts' shuffle is the same at every size; a join that is broadcast for small tables would hide it there.
    sets = materialise(read.join(wanted.hint("merge"), its).select("node", "set_id", "text").mapInArrow(_sets(words), "node bigint, n bigint, shingles array<bigint>").dropDuplicates(["node"]), "sets")

    others = members.filter("node <> leader")
    star = others.select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_n").alias("na"), F.col("n").alias("nb"))
    links = materialise(verified(star.filter(_near_sizes(percent)).select("a", "b").distinct(), sets, percent), "links")
    labels = components(links)

    # Every pair with a leader is decided; what is open lies between others of different components.
    placed = materialise(_of_components(others.select("band", "node"), labels), "placed")
    mixed_bands = materialise(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band"), "mixed")
    mixed = materialise(placed.join(mixed_bands, "band").select("node", "component").distinct(), "mixed_nodes")
    free(members, wanted, placed, mixed_bands)
    pairs = _cross_pairs(mixed, sets, percent)
    more = materialise(verified(pairs, sets, percent), "links")
    free(mixed, sets, pairs)
    if not more.isEmpty():
        free(labels)
        labels = components(links.union(more))
    free(links, more)

    found = materialise(_of_components(noded.select("row", "doc_id", "n", "node"), labels), "found")
    free(signed, same, labels)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    least = found.filter("n > 0").groupBy("component").agg(first, F.count("*").alias("size")).filter("size > 1").select("component", "first")
    out = found.join(materialise(least, "least"), "component", "left").withColumn("alone", (F.col("n") == 0) | F.col("first").isNull())
    component_id = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept, stays = F.col("doc_id").eqNullSafe(component_id), F.col("alone") | (F.col("row") == F.col("first.row"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), kept.alias("kept"), "row", stays.alias("stays"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("row", "stays")
