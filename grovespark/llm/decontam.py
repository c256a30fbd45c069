"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman alignment scores the passages.

An item's seeds are those of its word 3-grams that few items have, and of each stretch of it the two
that fewest have. How often a seed stands in the documents plays no part: it may be frequent only
because its item was copied often. One pass over the texts keeps the places of seeds, told by a Bloom
filter of them; an equality join with the seeds gives each place its items. Documents that share two
seeds with an item on nearby diagonals are aligned with it, word by word, so edited and paraphrased
copies score by what they keep. Words and seeds go by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, few, fresh, own, small, staged, table
from grovespark.llm.simhash import SEED, row_keys, sieve, sieved

GRAM = 3
#: Items of fewer words are too common a phrase to be told from prose, and are not looked for.
MIN_WORDS = 4
#: A seed is rare if so many items have it at most; of each STRETCH seeds of an item the rarest PER_STRETCH count anyway.
RARE_ITEMS = 10
STRETCH = 6
PER_STRETCH = 2
#: Seeds that a document must share with an item within BAND words of one diagonal; of an item with one seed, that one.
MIN_SEEDS = 2
BAND = 16
#: Alignment score over the item's words from which a passage counts as a copy; a match +1, all else -1.
MIN_SCORE = 0.5
#: Bits of the filter of seeds: so many for each, at most MOST_BITS (8 MB); a fuller one lets more through to the join.
BITS_PER_SEED = 1024
MOST_BITS = 1 << 26
#: Rows of seeds, and of items, that are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 500_000
BROADCAST_ITEMS = 10_000
#: Items that one row of work has a document aligned with.
ROW_ITEMS = 1000
#: Cells of one batch of alignments.
BATCH_CELLS = 1 << 20
#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 300_000

_WORD = re.compile(r"\w+")
_MIX = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    """The signed 64-bit hash of each word."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxh64_intdigest(word.encode("utf-8", "replace"), SEED)
        self[word] = found = found - (1 << 64) if found >> 63 else found
        return found


_hashes = _Hashes()


def hashes_of(text: str | None) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


def grams_of(hashes: np.ndarray) -> np.ndarray:
    """A hash of each GRAM words that follow each other."""
    n = len(hashes) - GRAM + 1
    out = np.zeros(max(n, 0), np.int64)
    for k in range(GRAM if n > 0 else 0):
        out = (out ^ (out >> np.int64(31))) * _MIX + hashes[k : k + n]
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): a row for each item_id and text of MIN_WORDS words or more, numbered; words are hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([hashes_of(t).tolist() for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), words], names=["item_id", "words"])

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    found = texts.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") >= MIN_WORDS)
    return staged(found.withColumn("item", F.monotonically_increasing_id()), "items")  # numbers are fixed once written


def seeds_of(items: DataFrame) -> DataFrame:
    """(gram, item, place, need): the seeds of items (item, words), where each stands, and how many different ones of its item must be met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [grams_of(np.array(w, np.int64)) for w in batch.column("words").to_pylist()]
            sizes = np.array([len(g) for g in grams], np.int64)
            cols = [pa.array(np.concatenate([*grams, np.empty(0, np.int64)])), batch.column("item").take(pa.array(np.repeat(np.arange(len(grams)), sizes))), pa.array(np.concatenate([*map(np.arange, sizes), np.empty(0, np.int64)]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "item", "place"])

    grams = items.select("item", "words").mapInArrow(run, "gram long, item long, place int")
    often = grams.distinct().groupBy("gram").agg(F.count_distinct("item").alias("items"))
    ranked = grams.join(often, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("item", F.expr(f"place div {STRETCH}")).orderBy("items", "place")))
    some = ranked.where((F.col("items") <= RARE_ITEMS) | (F.col("rank") <= PER_STRETCH)).select("gram", "item", "place")
    need = some.groupBy("item").agg(F.least(F.count_distinct("gram"), F.lit(MIN_SEEDS)).cast("int").alias("need"))
    return some.join(need, "item").select("gram", "item", "place", "need")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds: its length, a power of two of MOST_BITS at most, depends on their number."""
    bits = 1 << 16
    count = seeds.count()
    while bits < min(BITS_PER_SEED * count, MOST_BITS):
        bits *= 2
    slot = seeds.select(F.expr(f"gram & {bits - 1}L").alias("slot"))
    maps = slot.groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():  # MOST_BITS in all
        out[4096 * row["bucket"] : 4096 * (row["bucket"] + 1)] = np.frombuffer(row["map"], np.uint8)
    return out


def _hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, key, gram, at): where the documents (doc_id, text) may have a seed."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds))  # 8 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        low = np.int64(8 * len(known) - 1)
        for batch in batches:
            rows, grams, places = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = grams_of(hashes_of(text))
                slot = found & low
                at = np.flatnonzero(known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                rows.append(np.full(len(at), k))
                grams.append(found[at])
                places.append(at)
            row = pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))
            cols = [batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(np.concatenate([*grams, np.empty(0, np.int64)])), pa.array(np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "gram", "at"])

    return row_keys(docs, "text").mapInArrow(run, "doc_id long, key string, gram long, at long")


def candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, key, item, first, last): the least and the last diagonal of each band where a document shares enough seeds with an item.

    A band is 2 * BAND diagonals wide and the next one starts BAND further, so seeds within BAND of
    each other share one. Places of seeds are joined with these and counted by partial aggregates.
    """
    met = _hits(docs, seeds).join(seeds, "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    wide = 2 * BAND
    band = F.explode(F.array(F.floor(F.col("diagonal") / wide) * 2, F.floor((F.col("diagonal") + BAND) / wide) * 2 - 1)).alias("band")
    each = met.select("doc_id", "key", "item", "need", "gram", "diagonal", band).groupBy("doc_id", "key", "item", "band")
    found = each.agg(F.min("gram").alias("low"), F.max("gram").alias("high"), F.first("need").alias("need"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
    return found.where("need = 1 OR low != high").select("doc_id", "key", "item", "first", "last").distinct()


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(score, end) of the best local alignment of each (item, passage), arrays of word numbers.

    All pairs advance together, a row of the item at a time. A gap along the passage costs 1 a word, so
    the best cell to the left is a running maximum. end is the place after the last aligned word.
    """
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item, passage = np.full((len(pairs), m), -2, dtype=np.int64), np.full((len(pairs), n), -3, dtype=np.int64)
    for k, (a, b) in enumerate(pairs):
        item[k, : len(a)], passage[k, : len(b)] = a, b
    row = np.zeros((len(pairs), n + 1), dtype=np.int32)
    best, end = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int64)
    slope = np.arange(n + 1, dtype=np.int32)
    for i in range(m):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + np.where(item[:, i : i + 1] == passage, 1, -1), row[:, 1:] - 1))
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        top = row.argmax(axis=1)
        value = row[np.arange(len(pairs)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
    return list(zip(best.tolist(), end.tolist()))


def _scored(docs: DataFrame, met: DataFrame, items: DataFrame, min_score: float) -> DataFrame:
    """(doc_id, key, item_id, score, end_word) of the candidates (doc_id, key, item, first, last) that pass.

    Of the documents, only those with a candidate are shuffled; one with very many is aligned by several rows.
    """
    met = met.join(items, "item")
    rows = met.groupBy("doc_id", "key").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / ROW_ITEMS))
    rows = rows.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "parts")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    dealt = met.join(rows, same("doc_id", "d") & (F.col("key") == F.col("k"))).withColumn("part", F.pmod(F.xxhash64("item", "first"), F.col("parts")))
    work = dealt.groupBy("d", "k", "part").agg(F.collect_list(F.struct("item_id", "words", "first", "last")).alias("items"))
    work = staged(work, "work")
    texts = sieved(row_keys(docs, "text"), "doc_id", "key", sieve(rows.select(F.col("d").alias("doc_id"), F.col("k").alias("key"))), "met").where("met").select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])
    work = texts.join(work, same("doc_id", "d") & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, names, out = [], [], []
            longest = 0

            def flush() -> None:
                if pairs:
                    for (doc, key, item, low, n), (value, end) in zip(names, align(pairs)):
                        if value >= min_score * n:
                            out.append((doc, key, item, value / n, low + end))
                pairs.clear()
                names.clear()

            for row in batch.to_pylist():
                words = hashes_of(row["text"])
                for found in row["items"]:
                    item = np.array(found["words"], np.int64)
                    # a copy of half the score drifts by half the item's words at most, to either side
                    low = max(0, found["first"] - len(item) // 2 - BAND)
                    passage = words[low : found["last"] + len(item) + len(item) // 2 + BAND]
                    longest = max(longest, len(passage)) if pairs else len(passage)
                    pairs.append((item, passage))
                    names.append((row["doc_id"], row["key"], found["item_id"], low, len(item)))
                    if len(pairs) * longest > BATCH_CELLS:
                        flush()
            flush()
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "key", "item_id", "score", "end_word"])

    return work.mapInArrow(run, "doc_id long, key string, item_id long, score double, end_word long")


def _matched(docs: DataFrame, benchmark: DataFrame, min_score: float) -> DataFrame:
    """matches(), with the key of the text that each row was found in."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark)
    seeds = small(seeds_of(items), "seeds", BROADCAST_SEEDS)
    met = staged(candidates(docs, seeds), "candidates")
    return _scored(docs, met, few(items, BROADCAST_ITEMS), min_score)


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, end_word): the best passage of each document (doc_id, text) for each item (item_id, text) it copies.

    score is the alignment's score over the item's words (1: all of it, word for word), end_word the
    word after the passage. Null and empty texts and items match nothing, nor do items of fewer than
    MIN_WORDS words. Items that repeat an item_id with other texts are all looked for, the best of them
    counts. Rows that repeat a doc_id give one row, so do those without any, under a null one.
    """
    best = F.max(F.struct("score", (-F.col("end_word")).alias("end"))).alias("best")
    return _matched(docs, benchmark, min_score).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.end")).alias("end_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that copy no item, with their own columns.

    A row is judged by its own text, whatever other rows have its doc_id, or none. Texts of clean
    documents are not shuffled, but for a few that a Bloom filter of the others cannot tell from them.
    """
    bad = staged(_matched(docs, benchmark, MIN_SCORE).select("doc_id", "key").distinct(), "contaminated")
    doc, digest, met, of, by = fresh(docs, "doc", "digest", "met", "of", "by")
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = sieved(keyed, doc, digest, sieve(bad), met)
    named = bad.select(F.col("doc_id").alias(of), F.col("key").alias(by))
    clean = keyed.where(met).join(named, F.col(doc).eqNullSafe(F.col(of)) & (F.col(digest) == F.col(by)), "left_anti")
    return keyed.where(~F.col(met)).select(*own(docs)).unionByName(clean.select(*own(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of benchmark items in the documents; a document without any has no row."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
