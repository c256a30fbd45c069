"""Near-duplicate groups by SimHash fingerprints that differ in few bits.

Documents of equal fingerprint are one class from the start; all further work is on distinct
fingerprints. Two of them at most two bits apart agree, but for one bit, in one of the two halves
of 32 bits, so they share that half with some one bit blanked. Each fingerprint is indexed under
its 64 blanked halves, an equality join proposes pairs, the bits of the whole decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, fresh, own, staged, table

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints under one blanked half that are still joined pair by pair; more go another exact way.
PAIR_BUCKET = 32
#: Bits of the filter that tells most rows without a mark, so that their texts need no join: 8 MB, however many rows.
SIEVE_BITS = 1 << 26
#: Shingles hashed at a time, so that a long text needs no more memory than this.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text: bits set in over half of its shingles' hashes; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        hashes = np.fromiter((xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts[at:to], last[at:to])), np.uint64, to - at)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: bool = False) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text), with key=True also the digest of row_keys; fp is the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "key"] if key else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints.view(np.int64))], names=[*names, "fp"])

    return row_keys(docs, "text").select(*names, "text").mapInArrow(run, "doc_id long, key string, fp long" if key else "doc_id long, fp long")


def _blanked(fp: str = "fp") -> str:
    """The 64 signatures of a fingerprint, exact: which half, which bit is blanked, the other 31 bits."""
    half = f"(shiftrightunsigned({fp}, 32 * h) & 4294967295L)"
    one = f"(((h * 32 + b) * 4294967296L) + ({half} & ~shiftleft(1L, b)))"
    return f"flatten(transform(sequence(0, 1), h -> transform(sequence(0, 31), b -> {one})))"


def _twice_blanked(fp: str = "fp") -> str:
    """All ways to blank two of 64 bits: fingerprints that share one differ in these bits at most."""
    return f"flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(i * 64 + j AS ij, {fp} & ~(shiftleft(1L, i) | shiftleft(1L, j)) AS rest))))"


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect any two distinct fingerprints (fp) at most two bits apart.

    Signatures of up to PAIR_BUCKET fingerprints are joined pair by pair. Fingerprints under a fuller
    one are indexed by all two-bit blanks instead: at most four of them agree there, and any that do
    are linked, so no group is ever expanded into its pairs.
    """
    # a fixed number of parts, or a small table would be expanded in one or two tasks
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = prints.select("fp").repartition(parts, "fp").select("fp", F.explode(F.expr(_blanked())).alias("sig"))
    shared = staged(signed.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1"), "signatures")
    few = shared.where(F.col("n") <= PAIR_BUCKET).select("sig", "fp")
    near = few.select("sig", F.col("fp").alias("a")).join(few.select("sig", F.col("fp").alias("b")), "sig").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    )
    cells = (
        shared.where(F.col("n") > PAIR_BUCKET)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.expr(_twice_blanked())).alias("cell"))
        .groupBy("cell")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))  # at most four
        .where(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .where("a != b")
    )
    return near.select("a", "b").union(cells).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of the edges reaches, by alternating large and small stars.

    Each round writes the edges to the shared folder. Neighbourhoods are only ever reduced to a minimum
    and joined, never gathered.
    """
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = staged(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        before = state


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the least doc_id reachable over linked fingerprints. Null and empty texts share
    fingerprint zero. A null doc_id counts for no minimum; a group of such rows alone has none.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def row_keys(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, key, columns): key is a digest of the text, so that it and doc_id name a row up to equal ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), *columns)


def sieve(keys: DataFrame) -> DataFrame:
    """(bucket, map): a Bloom filter of SIEVE_BITS bits over keys (doc_id, key), small enough to broadcast at any size."""
    slot = keys.select(F.expr(f"1 + pmod(xxhash64(doc_id, key), {SIEVE_BITS})").alias("slot"))
    return staged(slot.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("map")), "sieve")


def sieved(rows: DataFrame, doc_id: str, key: str, filter_: DataFrame, met: str) -> DataFrame:
    """rows with a column met: false for rows that the filter's keys do not have, true for the others and few besides.

    rows has columns doc_id and key of these names, and none named met.
    """
    slot, bucket, bits = fresh(rows.withColumn(met, F.lit(0)), "slot", "bucket", "map")
    maps = filter_.select(F.col("bucket").alias(bucket), F.col("map").alias(bits))
    place = f"bitmap_bit_position(`{slot}`)"
    byte = f"cast(conv(hex(substring(`{bits}`, cast({place} div 8 + 1 AS int), 1)), 16, 10) AS int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast({place} % 8 AS int)) & 1 = 1, false)")
    placed = rows.withColumn(slot, F.expr(f"1 + pmod(xxhash64(`{doc_id}`, `{key}`), {SIEVE_BITS})"))
    return placed.join(F.broadcast(maps), F.expr(f"bitmap_bucket_number(`{slot}`)") == F.col(bucket), "left").withColumn(met, hit).drop(slot, bucket, bits)


def first_of_components(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The document of the least doc_id of each component, one row each; components without any doc_id stay whole.

    rows (doc_id, key, node) has a row for each of docs, roots (node, root) the nodes linked to others.
    A row is judged by its own text, whatever other rows have its doc_id, or none. Only rows that go,
    or that equal another one, are marked; texts without a mark are not shuffled.
    """
    least = rows.groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first"))
    rooted = staged(least.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    leaders = rooted.groupBy("root").agg(F.min("first").alias("first"))
    without = leaders.where("first IS NULL").join(rooted.select("root", "node"), "root").select("node")
    nameless = rows.where("doc_id IS NULL").join(without, "node", "left_semi").select("doc_id", "key").distinct()
    kept = leaders.where("first IS NOT NULL").select("first.doc_id", "first.key").union(nameless).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    each = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    judged = each.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    marks = judged.select("doc_id", "key", F.when(F.col("_key").isNull(), "gone").when(F.col("doc_id").isNotNull() & (F.col("n") > 1), "once").alias("mark")).where("mark IS NOT NULL")
    marks = staged(marks, "marks")
    doc, digest, met, mark, of, by = fresh(docs, "doc", "digest", "met", "mark", "of", "by")
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = sieved(keyed, doc, digest, sieve(marks.select("doc_id", "key")), met)
    named = marks.select(F.col("doc_id").alias(of), F.col("key").alias(by), F.col("mark").alias(mark))
    some = keyed.where(met).join(named, F.col(doc).eqNullSafe(F.col(of)) & (F.col(digest) == F.col(by)), "left")
    once = some.where(F.col(mark) == "once").dropDuplicates([doc, digest])
    return keyed.where(~F.col(met)).select(*own(docs)).unionByName(some.where(F.col(mark).isNull()).select(*own(docs))).unionByName(once.select(*own(docs)))


def first_of_group(docs: DataFrame) -> DataFrame:
    """One document, of the least doc_id, of each group; groups without any doc_id stay whole."""
    rows = staged(fingerprints(docs, key=True).withColumnRenamed("fp", "node"), "fingerprints")
    return first_of_components(docs, rows, components(links(rows.select(F.col("node").alias("fp")).distinct())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
