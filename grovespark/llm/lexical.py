"""Ranked lexical search: all documents scored for a set of queries over an inverted index.

The index is a table of segments. A segment numbers its documents by ascending doc_id and has, for each
of its terms, a posting list of these numbers and occurrences. A search reads every segment once. It
walks the postings of an item's terms through fixed windows of document numbers: contributions are
added into an array of one window, which stays in the cache, a bitset says which of its places were
met, and these are harvested into a heap of the best. Heaps of all tasks meet in one ranking.

Scores are whole numbers, so they are the same in any order of summation.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, new_folder, table

#: Results of one item.
TOP = 20
#: Documents of a window; its array of scores takes 32 KB.
WINDOW = 4096
#: A segment is closed at this many documents or term occurrences; a longer document is one of its own.
SEGMENT_DOCS = 4 * WINDOW
SEGMENT_TERMS = 2_000_000
#: Segments of one file, so that a reader holds few of them.
FILE_SEGMENTS = 8
#: Items, and characters of items on average, that one pass over the index answers.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8 << 20
#: Parts in which the ranking of an item is made first.
SALT = 16

#: Bytes of a normalised text: A-Z in lower case; ASCII digits, letters and all bytes from 128 on stay, the rest are delimiters.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SEGMENT = "doc_ids array<long>, lengths array<int>, terms array<string>, starts array<int>, slots array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


class _Numbers(dict):
    """Numbers terms as they are asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Segment:
    """Documents of a segment that is still open."""

    def __init__(self) -> None:
        self.numbers, self.ids, self.doc_ids, self.size = _Numbers(), [], [], 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
        self.size += len(terms)

    def row(self) -> pa.RecordBatch:
        n = len(self.doc_ids)
        order = sorted(range(n), key=lambda k: (self.doc_ids[k] is None, self.doc_ids[k] or 0))
        slot = np.empty(n, np.int64)
        slot[order] = np.arange(n)
        lengths = np.fromiter(map(len, self.ids), np.int64, n)
        pair = np.concatenate(self.ids).astype(np.int64) * n + np.repeat(slot, lengths)
        pair, counts = np.unique(pair, return_counts=True)
        starts = np.searchsorted(pair, np.arange(len(self.numbers) + 1) * n)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        cols = [
            pa.array([self.doc_ids[k] for k in order], pa.int64()),
            pa.array(lengths[order], pa.int32()),
            pa.array(list(self.numbers), pa.binary()).cast(pa.string()),
            *(pa.array(x, pa.int32()) for x in (starts, pair % n, counts)),
        ]
        return pa.RecordBatch.from_arrays(list(map(one, cols)), names=["doc_ids", "lengths", "terms", "starts", "slots", "counts"])


def index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The segments of docs (doc_id, text), written to path (default: a new table in the shared folder).

    Every row is a document of its own, whatever its doc_id; null and empty texts have no terms.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or new_folder(spark, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                terms = (text or b"").translate(_NORMAL).split()
                if segment.doc_ids and (segment.size + len(terms) > SEGMENT_TERMS or len(segment.doc_ids) >= SEGMENT_DOCS):
                    yield segment.row()
                    segment = _Segment()
                segment.add(doc_id, terms)
        if segment.doc_ids:
            yield segment.row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(run, SEGMENT).write.option("maxRecordsPerFile", FILE_SEGMENTS).parquet(path)
    return spark.read.schema(SEGMENT).parquet(path)


class _Postings:
    """The postings of the wanted terms in one segment, as (places, contributions) and a bitset for each window."""

    def __init__(self, row: dict, wanted: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc_ids = row["doc_ids"].values
        starts, slots, counts = (row[c].values.to_numpy() for c in ("starts", "slots", "counts"))
        lengths = row["lengths"].values.to_numpy().astype(np.int64)
        m = 75 + 25 * lengths * n_docs // max(n_terms, 1)
        self.windows = -(-len(lengths) // WINDOW)
        edges = np.arange(self.windows + 1) * WINDOW
        number = pc.index_in(row["terms"].values, value_set=wanted)
        here = np.flatnonzero(pc.is_valid(number).to_numpy(zero_copy_only=False))
        names = number.fill_null(0).to_numpy(zero_copy_only=False)
        #: by number of a wanted term: for each window, None or (places, contributions, bitset)
        self.of: dict[int, list] = {}
        for k in here.tolist():
            at, tf = slots[starts[k] : starts[k + 1]], counts[starts[k] : starts[k + 1]].astype(np.int64)
            part = weights[names[k]] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
            cut = np.searchsorted(at, edges)
            self.of[int(names[k])] = [self._window(at[a:b] - w * WINDOW, part[a:b]) if a < b else None for w, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))]

    @staticmethod
    def _window(places: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        met = np.zeros(WINDOW, bool)
        met[places] = True
        return places, parts, np.packbits(met)


def _harvest(heap: list, top: int, places: np.ndarray, scores: np.ndarray, doc_ids: pa.Array, base: int) -> None:
    """Put the best of a window into the heap of (score, has an id, -doc_id), the worst on top."""
    if len(heap) == top:
        good = scores >= heap[0][0]
        places, scores = places[good], scores[good]
    if len(places) > top:
        least = np.partition(scores, -top)[-top]
        more, same = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        some = np.concatenate([more, same[: top - len(more)]])  # places ascend with doc_id
        places, scores = places[some], scores[some]
    for place, score in zip(places.tolist(), scores.tolist()):
        doc_id = doc_ids[base + place].as_py()
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < top:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _document_counts(segments: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many documents each wanted term stands."""
    shared = segments.sparkSession.sparkContext.broadcast(wanted)  # terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total = pa.array(shared.value, pa.string()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in batch.to_struct_array():
                number = pc.index_in(row["terms"].values, value_set=names)
                here = np.flatnonzero(pc.is_valid(number).to_numpy(zero_copy_only=False))
                total[number.fill_null(0).to_numpy(zero_copy_only=False)[here]] += np.diff(row["starts"].values.to_numpy())[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(total[some])], names=["term", "df"])

    counts = segments.select("terms", "starts").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counts.collect()}


def _block_hits(segments: DataFrame, items: list[tuple], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(number, doc_id, score): each task's best documents for each item of a block."""
    bags: list[dict[str, int]] = []
    for _, text in items:
        bags.append({})
        for term in terms_of(text):
            bags[-1][term.decode()] = bags[-1].get(term.decode(), 0) + 1
    wanted = sorted({t for bag in bags for t in bag})
    df = _document_counts(segments, wanted)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in wanted], np.int64)
    at = {t: k for k, t in enumerate(wanted)}
    numbered = [[(at[t], n) for t, n in bag.items()] for bag in bags]
    shared = segments.sparkSession.sparkContext.broadcast((wanted, weights, numbered))  # of BLOCK_ITEMS items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, numbered = shared.value
        names, heaps = pa.array(wanted, pa.string()), [[] for _ in numbered]
        scores = np.zeros(WINDOW, np.int64)
        for batch in batches:
            for row in batch.to_struct_array():
                postings = _Postings(row, names, weights, n_docs, n_terms)
                for w in range(postings.windows):
                    for bag, heap in zip(numbered, heaps):
                        scores[:] = 0
                        met = None
                        for term, n in bag:
                            if (found := postings.of.get(term)) and (part := found[w]):
                                scores[part[0]] += n * part[1]
                                met = part[2] if met is None else met | part[2]
                        if met is not None:
                            places = np.flatnonzero(np.unpackbits(met))
                            places = places[scores[places] > 0]
                            _harvest(heap, top, places, scores[places], postings.doc_ids, w * WINDOW)
        rows = [(k, -no if has else None, score) for k, heap in enumerate(heaps) for score, has, no in heap]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))], names=["number", "doc_id", "score"])

    return segments.mapInArrow(run, "number int, doc_id long, score long")


def search(segments: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents, with a score above 0, of each item (item_id, text).

    Equal scores go by ascending doc_id, rows without one last. An item without terms, or without terms
    that the index has, gets no rows. Equal items count once; different texts under one item_id are
    ranked each by itself. Documents that repeat a doc_id are ranked each.
    """
    spark = segments.sparkSession
    bounded_batches(spark)
    sizes = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"), F.size(F.filter("lengths", lambda x: x > 0)).alias("docs")
    total = segments.select(*sizes).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna(subset=["text"])
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        block = [(r["item_id"], r["text"]) for r in items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {k}")).distinct().collect()]
        hits = _block_hits(segments, block, total["docs"] or 0, total["terms"] or 0, top)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "number int, item_id long")
        part = hits.join(F.broadcast(names), "number").withColumn("block", F.lit(k))  # a row for each item of the block
        out = part if out is None else out.unionAll(part)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("block", "number", "salt").orderBy(*best)
    some = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "number").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
w AS (SELECT doc_id, n, unnest(terms) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM w GROUP BY ALL),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
b AS (SELECT item_id, term, count(*) AS k FROM i GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
c AS (
  SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM b JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
