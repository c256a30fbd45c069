"""Near-copy groups by SimHash and shared five-word shingles: every pair of texts with a Jaccard similarity of 0.8 or more is linked.

Texts of one shingle set are one class from the start (sets and shingles go by 64-bit hashes); all
further work is on distinct sets. First come the links of SimHash fingerprints, as simhash.links
joins them, each verified on whole sets. Fingerprints of similar texts may differ in more bits than any
equality join can blank, so the rest is found by shingles. In any one order of all shingles, two sets that similar share a
shingle among the first fifth and one of each (prefix filter). Shingles that are common in a sample of
the texts come last in the order, which changes the work only, never the result. Within each shared
shingle, sets are compared with a few of its sets first. What these links leave in different
components is then compared pair by pair, so a group of near copies is not expanded into its pairs,
and no pair that could join two components is left out. A bitmap of each set, where every shingle
flips a bit, differs in no more bits than the sets in shingles; pairs whose bitmaps differ too much
are dropped by it, whole sets are read for the few others only. Sets that crowd under one shingle are
dealt to blocks, and compared by their bitmaps before they make a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, staged
from grovespark.llm.simhash import SEED, components, fingerprint, first_of_components, links, row_keys, sieve, sieved

SHINGLE = 5
#: Bits of a small set's bitmap; larger sets have PER_SHINGLE a shingle or more, always a power of two.
BITS = 1024
PER_SHINGLE = 4
#: Sets under one shingle that are paired without their bitmaps; of more, BLOCK of them meet as many in a task.
CROWD = 32
BLOCK = 1024
#: The sample that orders shingles: one text in SAMPLE, shingles in COMMON of them or more, at most MOST of these.
SAMPLE = 32
COMMON = 3
MOST = 200_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's five-word shingles, sorted; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, last = (ends - sizes).tolist(), (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last)).view(np.int64))


def _set_id(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def bitmap(found: np.ndarray) -> np.ndarray:
    """A set's bitmap as 64-bit numbers: bit h modulo its length flips for each hash h. Both halves of one, combined by XOR, are the bitmap of half the length."""
    n = BITS
    while n < PER_SHINGLE * len(found):
        n *= 2
    return np.packbits(np.bincount(found & (n - 1), minlength=n).astype(np.uint8) & 1).view(np.int64)


def _head(bits: np.ndarray) -> np.ndarray:
    """The bitmap of BITS bits that a longer one folds to."""
    return np.bitwise_xor.reduce(bits.reshape(-1, BITS // 64), axis=0)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, texts): those in COMMON texts of the sample or more, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_lists([shingles(x) for x in batch.column("text").to_pylist()])], names=["all"])

    part = docs.where(F.expr(f"pmod(xxhash64(text, doc_id), {SAMPLE}) = 0")).select("text").mapInArrow(run, "all array<long>")
    counts = part.select(F.explode("all").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(MOST).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, node, size, head, bits, prefix): a row per document; fp is its fingerprint, node the number of its shingle set, bits the bitmap, head that folded to BITS."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))  # of MOST shingles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = common.value
        for batch in batches:
            prints, nodes, sizes, bits, prefixes = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                prints.append(fingerprint(text))
                nodes.append(_set_id(found))
                sizes.append(len(found))
                bits.append(bitmap(found))
                weight = np.zeros(len(found), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
                    weight = np.where(names[at] == found, counts[at], 0)
                prefixes.append(found[np.lexsort((found, weight))[: len(found) // 5 + 1]])
            cols = [batch.column("doc_id"), batch.column("key"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), _lists([_head(x) for x in bits]), _lists(bits), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "fp", "node", "size", "head", "bits", "prefix"])

    return row_keys(docs, "text").mapInArrow(run, "doc_id long, key string, fp long, node long, size int, head array<long>, bits array<long>, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, all): the whole sets of the wanted (node, doc_id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists([shingles(x) for x in batch.column("text").to_pylist()])], names=["node", "all"])

    some = sieved(row_keys(docs, "text"), "doc_id", "key", sieve(wanted.select("doc_id", "key")), "met").where("met")
    texts = some.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.key") == F.col("w.key")))
    return texts.select("node", "text").mapInArrow(run, "node long, all array<long>")


def _apart(a: str, b: str) -> Column:
    """Bits in which two bitmaps of BITS bits differ."""
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(BITS // 64)))


def _alike(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _wide_apart(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ, the longer one folded to the length of the other; lengths at most a factor of two apart."""
    fold = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    return F.expr(f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets that are similar: 9 * |A and B| >= 4 * (|A| + |B|), or no more than a ninth of both apart."""
    both = F.col("size_a") + F.col("size_b")
    left, right = (classes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("head").alias(f"bits_{c}")) for c in "ab")
    near = staged(pairs.join(left, "a").join(right, "b").where(9 * _apart("bits_a", "bits_b") <= both).select("a", "b"), "near")
    left, right = (classes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    near = staged(near.join(left, "a").join(right, "b").where(9 * _wide_apart("bits_a", "bits_b") <= both).select("a", "b"), "near")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # one row of documents for each set; equal rows repeat it
    wanted = staged(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("node", "m.doc_id", "m.key"), "wanted")
    sets = staged(_sets(docs, wanted), "sets").dropDuplicates(["node"])
    left, right = (sets.select(F.col("node").alias(c), F.col("all").alias(f"all_{c}")) for c in "ab")
    return near.join(left, "a").join(right, "b").where(9 * F.size(F.array_intersect("all_a", "all_b")) >= 4 * (F.size("all_a") + F.size("all_b"))).select("a", "b")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """(node, size, o): pairs of sets that SimHash proposes, o a struct of the other's node and size. Sets of one fingerprint are paired with the least of them, that with the least of each linked fingerprint."""
    least = classes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("o"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("o").alias(f"o{c}"))
    linked = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select("oa.node", "oa.size", F.col("ob").alias("o"))
    return classes.select("fp", "node", "size").join(least, "fp").select("node", "size", "o").union(linked)


def roots(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of all sets that are linked to another one; rows as _prefixes gives them."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = staged(rows.select("fp", "node", "size", "head", "bits", "prefix").repartition(parts, "node").dropDuplicates(["node"]), "classes")
    places = classes.select("node", "size", F.posexplode("prefix").alias("pos", "shingle"))
    own, mixed = F.struct("node", "size"), F.xxhash64("node")
    by = Window.partitionBy("shingle")
    some = F.array(F.min(own).over(by), F.max(own).over(by), F.min_by(own, mixed).over(by), F.max_by(own, mixed).over(by))
    shared = staged(places.withColumn("n", F.count("*").over(by)).withColumn("some", some).where("n > 1"), "shingles")
    near = _by_fingerprint(classes).union(shared.select("node", "size", F.explode("some").alias("o"))).where((F.col("node") != F.col("o.node")) & _alike("size", "o.size"))
    near = near.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
    first = staged(_links(docs, rows, classes, near), "links")
    found = components(first).withColumnRenamed("node", "_node")
    named = shared.join(found, F.col("node") == F.col("_node"), "left").select("shingle", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
    apart = named.withColumn("low", F.min("root").over(by)).withColumn("high", F.max("root").over(by)).withColumn("n", F.count("*").over(by))
    apart = staged(apart.where("low != high").drop("low", "high"), "apart")
    most = F.least("l.pos", "r.pos") + 1 + F.least(F.col("l.size") - F.col("l.pos") - 1, F.col("r.size") - F.col("r.pos") - 1)
    can = (F.col("l.root") < F.col("r.root")) & _alike("l.size", "r.size") & (9 * most >= 4 * (F.col("l.size") + F.col("r.size")))
    few = apart.where(F.col("n") <= CROWD)
    pairs = few.alias("l").join(few.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & can).select("l.node", F.col("r.node").alias("other"))
    # a crowd's sets are dealt to blocks, each pair of blocks is a task's; bitmaps decide before a pair is a row
    crowd = apart.where(F.col("n") > CROWD).join(classes.select("node", "head"), "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    crowd = crowd.withColumn("mine", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    l, r = crowd.alias("l"), crowd.alias("r")
    met = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.mine") == F.col("r.other")) & (F.col("l.other") == F.col("r.mine"))
    close = l.join(r, met & can & (9 * _apart("l.head", "r.head") <= F.col("l.size") + F.col("r.size"))).select("l.node", F.col("r.node").alias("other"))
    rest = pairs.union(close).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return components(first.union(_links(docs, rows, classes, rest)))


def first_of_group(docs: DataFrame) -> DataFrame:
    """One document, of the least doc_id, of each group of near copies; groups without any doc_id stay whole."""
    bounded_batches(docs.sparkSession)
    rows = staged(_prefixes(docs), "prefixes")
    return first_of_components(docs, rows.select("doc_id", "key", "node"), roots(docs, rows))
