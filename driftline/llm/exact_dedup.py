"""Exact duplicates by deterministic block naming.

A text is normalised (each run of space, tab, \\n, \\v, \\f, \\r becomes one space) and cut into
blocks of a fixed number of bytes. Equal blocks, brought together by sorting, get one integer
name. Adjacent pairs of names are then named the same way, level by level, until a document has a
single name. Two documents of as many blocks have the same name if and only if their texts are
equal: names stand for contents, so nothing rests on a hash.

Plan. One pass over the texts cuts blocks; a task sends each distinct block of a batch once, with
the places where it stands, so that a text copied into a third of all rows arrives as a few rows
from each task. Contents are shuffled once; from there on only integers move. A level names the
distinct pairs (combined map-side), and the rows fetch their names by a join that adaptive
execution may split. There are log2(longest text / block) levels.

Defined results. A null text counts as empty; an empty text is one empty block. Repeated rows, and
rows that share a doc_id, are rows of their own; of equal texts the row with the smallest doc_id
stays (nulls last, then the first read), and only that one has kept = true. An empty table gives
an empty result. Other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import free, materialise, table

BLOCK_BYTES = 2048

_SPACE = b" \t\n\x0b\x0c\r"
_PLACE = pa.struct([("rid", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.string())])
_OUT = pa.schema([("block", pa.binary()), ("places", pa.list_(_PLACE))])
_OUT_DDL = "block binary, places array<struct<rid bigint, pos int, n int, doc_id bigint, sha string>>"


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[0] in _SPACE) + b" ".join(words) + b" " * (text[-1] in _SPACE)


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True)
            found: dict[bytes, list] = {}
            for rid, doc_id, text in rows:
                b = normalised(text.as_py() or b"")
                sha, n = hashlib.sha256(b).hexdigest(), max(1, -(-len(b) // size))
                for pos in range(n):
                    place = {"rid": rid, "pos": pos, "n": n, "doc_id": None if pos else doc_id, "sha": None if pos else sha}
                    found.setdefault(b[pos * size : (pos + 1) * size], []).append(place)
            keys = list(found)
            for i in range(0, len(keys), 2000):
                part = keys[i : i + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([found[k] for k in part], pa.list_(_PLACE))], schema=_OUT)

    return run


def _named(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows with `name`, an integer for each distinct value of the keys."""
    distinct = rows.select(*keys).distinct().sortWithinPartitions(*keys)
    names = materialise(distinct.withColumn("name", F.monotonically_increasing_id()), label)
    return rows.join(names, keys)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, row: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, text_sha256, n_blocks, name. (n_blocks, name) is the text's identity."""
    rid = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    numbered = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = numbered.mapInArrow(_cut(block_bytes), _OUT_DDL)
    # A block comes once from each batch at most, so that the rows of one block stay few.
    sorted_blocks = cut.repartition("block").sortWithinPartitions("block").withColumn("i", F.monotonically_increasing_id())
    named = sorted_blocks.select(F.min("i").over(Window.partitionBy("block")).alias("name"), "places")
    level = materialise(named.select("name", F.explode("places").alias("p")).select("p.*", "name"), "blocks")
    heads = level.filter("pos = 0").select("rid", "doc_id", F.col("sha").alias("text_sha256"), "n", "name")
    longest = level.agg(F.max("n")).first()[0] or 1
    done = [heads.filter("n = 1").drop("n").withColumn("n_blocks", F.lit(1))]
    rows, width = level.filter("n > 1").select("rid", "pos", "n", "name"), 1
    ended = []
    while width < longest:
        # A document of n blocks has ceil(n / width) names here; those that just came to one are done.
        pairs = rows.groupBy("rid", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        width *= 2
        pairs = materialise(pairs, "pairs")
        named_pairs = materialise(_named(pairs, ["left", "right"], "names").select("rid", "pos", "n", "name"), "level")
        free(pairs)
        ended.append(named_pairs.filter(F.col("n") <= width).select("rid", "name"))
        rows = named_pairs.filter(F.col("n") > width)
    if ended:
        last = ended[0]
        for x in ended[1:]:
            last = last.unionByName(x)
        many = heads.filter("n > 1").drop("name").join(last, "rid").withColumnRenamed("n", "n_blocks")
        done.append(many)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("rid", "doc_id", "text_sha256", "n_blocks", "name")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row for every row of docs.

    row names the rows: the values of the column that is given as row, or numbers of this run's own.
    """
    ids = materialise(identities(docs, block_bytes, row), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = ids.groupBy("n_blocks", "name").agg(F.min(order).alias("first"), F.count("*").alias("size")).filter("size > 1")
    found = ids.join(materialise(groups, "groups"), ["n_blocks", "name"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("rid") == F.col("first.rid"))).alias("kept"),
        "text_sha256", F.col("rid").alias("row"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
