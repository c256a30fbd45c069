"""Best-fit packing of token pieces into fixed-length sequences by bin completion.

Pieces of equal length are interchangeable, so the search runs over the histogram of lengths: at
most ``capacity`` numbers, however many documents there are. It yields patterns (the lengths in
one sequence) with the number of sequences of each; pieces find their place by their rank among
the pieces of their length, which is counted in salted blocks so that no length meets in one task.
"""

from __future__ import annotations

import bisect
import functools
import gc
import itertools
import json
import os
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, staged, table

CAPACITY = 4096
END_ID = 1
#: Bounds of the search, None for none: nodes in all, steps of one enumeration of fillings, fillings tried at a node.
NODE_BUDGET = 20_000
FILL_STEPS = 400
FILL_WIDTH = 6
#: Words, and as many runs of letters or signs in words, whose ids a Python worker remembers, and how
#: many where it shares an executor with what other stages left (about 570 MB and 350 MB).
CACHE_WORDS = 900_000
SMALL_CACHE_WORDS = 200_000
#: Rows that a block of the ranking holds on average, at most, and least blocks.
BLOCK_ROWS = 2_000_000
LEAST_BLOCKS = 64

#: A special token of the vocabulary; words that might hold it are encoded alone.
MARK = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words that normalising only puts in lower case, and how the vocabulary's pre-tokenizer splits these.
_SIMPLE = re.compile(r"[\x21-\x7e\u00c0-\u00ff]+")
_RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


#: How the vocabulary that the shortcuts below are made for splits words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(path: str) -> bool:
    """Whether a tokenizer file normalises and splits texts so that words may be encoded one by one, as WordIds does."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps = [x.get("type") for x in (found.get("normalizer") or {}).get("normalizers", [])]
    split = next(iter((found.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    marks = {x["content"] for x in found.get("added_tokens", []) if not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"])}
    plain = not found.get("post_processor") and not found.get("truncation") and not found.get("padding")
    return plain and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _SPLIT} and split.get("invert") is True and MARK in marks == {x["content"] for x in found["added_tokens"]}


class TextIds:
    """Token ids of texts as little-endian 32-bit bytes, each text encoded whole: for any vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, equal to encoding each text whole.

    For vocabularies of which by_words is true: they never join across white space, so words are
    encoded once and remembered.
    """

    def __init__(self, path: str, remembered: int = CACHE_WORDS):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.mark = self.tokenizer.token_to_id(MARK)
        self.plain, self.runs = Tokenizer.from_file(path), {}
        self.plain.normalizer = None

    def _encode(self, tokenizer, words: list[str], into: dict[str, bytes]) -> None:
        """The ids of words without marks, many in one call with a mark between them."""
        parts = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([MARK.join(x) for x in parts], add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            at = [0, *(np.flatnonzero(ids == self.mark) + 1).tolist(), len(ids) + 1]
            data = ids.tobytes()
            into.update((w, data[4 * a : 4 * b - 4]) for w, a, b in zip(part, at, at[1:]))

    def learn(self, words: list[str]) -> None:
        """Encode words. Each run of letters or signs is encoded by itself, so of words whose normal form is
        plain, these parts are remembered too."""
        simple, others = [], []
        for w in words:
            if "<|" in w:
                self.known[w] = np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                (simple if w.isascii() or _SIMPLE.fullmatch(w) else others).append(w)
        self._encode(self.tokenizer, others, self.known)
        split = [_RUN.findall(w.lower()) for w in simple]
        runs = self.runs
        missing = list({x for y in split for x in y}.difference(runs))
        self._encode(self.plain, missing, runs)
        self.known.update((w, b"".join(map(runs.__getitem__, y))) for w, y in zip(simple, split))
        if len(runs) > self.remembered:
            for x in missing:
                del runs[x]

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split = []
        for text in texts:
            for c in "\t\n\x0b\x0c\r":
                text = text.replace(c, " ")
            split.append(text.split(" "))
        missing = set().union(*split).difference(known)
        self.learn(list(missing))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > self.remembered:  # words met early are the frequent ones and stay
            for w in missing:
                del known[w]
        return out


@functools.lru_cache(maxsize=1)
def word_ids(path: str, remembered: int = CACHE_WORDS) -> WordIds | TextIds:
    return WordIds(path, remembered) if by_words(path) else TextIds(path)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = CACHE_WORDS) -> DataFrame:
    """The pieces of each document (doc_id, text): its ids, then end_id, cut only where longer than capacity.

    A null or empty text is the end id alone. Rows that repeat give pieces that repeat.
    """
    bounded_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer, remembered)
        gc.disable()  # this worker makes strings and numbers only, which need no cycle collector
        for batch in batches:
            rows = []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a bin, number of such bins)."""
    rooms: list[int] = []  # free lengths of open bins, ascending
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(free: int, content: tuple[int, ...], n: int) -> None:
        if n:
            if free not in bins:
                bisect.insort(rooms, free)
                bins[free] = []
            bins[free].append((content, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left and (at := bisect.bisect_left(rooms, size)) < len(rooms):
            free = rooms[at]
            content, n = bins[free].pop()
            if not bins[free]:
                del bins[free]
                rooms.pop(at)
            fit = free // size
            full = min(n, left // fit)
            put(free - fit * size, content + (size,) * fit, full)
            left -= full * fit
            if full < n and left and left < fit:
                put(free - left * size, content + (size,) * left, 1)
                full, left = full + 1, 0
            put(free, content, n - full)
        fit = capacity // size
        put(capacity - fit * size, (size,) * fit, left // fit)
        if left % fit:
            put(capacity - left % fit * size, (size,) * (left % fit), 1)
    merged: Counter = Counter()
    for group in bins.values():
        for content, n in group:
            merged[content] += n
    return list(merged.items())


class Stock:
    """How many items of each length are at hand; the lengths are also the bits of one number, so the longest that fits is found at once."""

    def __init__(self, counts: dict[int, int]):
        rng = random.Random(5)
        self.n = dict(counts)
        self.live = sum(1 << s for s in counts)
        self.most = max(counts)
        self.turned = sum(1 << self.most - s for s in counts)  # live, read from the longest down
        self.mark = {s: rng.getrandbits(128) for s in sorted(counts)}
        self.state = 0  # names the counts: the sum of what was taken, each length with its mark

    def longest(self, limit: int) -> int:
        """The longest length at hand up to limit, or 0."""
        return max(0, (self.live & ((2 << limit) - 1)).bit_length() - 1) if limit > 0 else 0

    def take(self, size: int, k: int = 1) -> None:
        self.n[size] -= k
        self.state += k * self.mark[size]
        if not self.n[size]:
            self.live ^= 1 << size
            self.turned ^= 1 << self.most - size

    def put(self, size: int, k: int = 1) -> None:
        if not self.n[size]:
            self.live ^= 1 << size
            self.turned ^= 1 << self.most - size
        self.n[size] += k
        self.state -= k * self.mark[size]

    def pairs(self, total: int, limit: int) -> Iterator[tuple[int, int]]:
        """Two lengths at hand of this total, the first at most limit and at least the second, longest first."""
        shift = self.most - total
        both = self.live & (self.turned >> shift if shift >= 0 else self.turned << -shift) & ((2 << min(limit, total)) - 1)
        while both:
            a = both.bit_length() - 1
            both ^= 1 << a
            if a < total - a:
                return
            if a > total - a or self.n[a] > 1:
                yield a, total - a


def fillings(stock: Stock, first: int, capacity: int, slack: int, steps: int | None = FILL_STEPS, width: int | None = FILL_WIDTH) -> tuple[list[tuple[int, ...]], bool]:
    """(undominated contents of a bin around its longest item first, least waste first; whether all were met).

    A content is dominated, and left out, if an item more would still fit or if one of its items can
    be exchanged for a longer one at hand; an item that fills the rest dominates all others. Waste is at
    most slack. first is in stock.
    """
    stock.take(first)
    try:
        rest = capacity - first
        if rest and stock.longest(rest) == rest:
            return [(first, rest)], True
        found: dict[tuple[int, ...], int] = {}
        left = [steps if steps is not None else -1]
        least = (stock.live & -stock.live).bit_length() - 1
        whole = True
        if width is not None:  # contents of two and three items without waste are found at once; enough of them need no search
            found.update((x, 0) for x in itertools.islice(stock.pairs(rest, rest), width))
            a = stock.longest(rest)
            while a and len(found) < width and 3 * a >= rest:
                stock.take(a)
                found.update(((a, *x), 0) for x in itertools.islice(stock.pairs(rest - a, a), width - len(found)))
                stock.put(a)
                a = stock.longest(a - 1)
            if len(found) >= width:
                return [(first, *x) for x in found], False

        def search(free: int, limit: int, content: tuple[int, ...]) -> None:
            nonlocal whole
            left[0] -= 1
            size = stock.longest(min(free, limit))
            if not size:
                if free <= slack and not stock.longest(free) and all(stock.longest(s + free) <= s for s in set(content)):
                    found[content] = free
                return
            while size:
                if left[0] == 0 or (width is not None and len(found) >= width and min(found.values()) == 0):
                    whole = False
                    return
                if slack < free - size < least:  # too much for waste, too little for another item
                    size = stock.longest(min(size - 1, free - least))
                    continue
                stock.take(size)
                search(free - size, size, (*content, size))
                stock.put(size)
                size = stock.longest(size - 1)

        search(rest, rest, ())
        order = sorted(found, key=lambda c: (found[c], len(c), [-x for x in c]))
        return [(first, *c) for c in order[:width]], whole and (width is None or len(order) <= width)
    finally:
        stock.put(first)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing goes below: by volume, and with items of over half a bin each in one of its own."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in {0, *(s for s in counts if 2 * s <= capacity)}:  # items below k left out
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = {s: n for s, n in counts.items() if 2 * s > capacity and s <= capacity - k}
        small = sum(s * n for s, n in counts.items() if k <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best


def search_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODE_BUDGET, steps: int | None = FILL_STEPS, width: int | None = FILL_WIDTH) -> tuple[list[tuple[tuple[int, ...], int]], str]:
    """(patterns and their numbers that hold exactly counts, why the search ended).

    Best-fit decreasing is the first incumbent. The search completes the bin of the longest item left by
    each undominated filling, as often as the counts allow first, then fewer times, and leaves a branch
    once the waste so far exceeds what a better solution may waste, or where the same items are left as
    before in no fewer bins. It ended by 'bound' or 'complete' if no packing has fewer bins; 'fillings' and
    'nodes' say which limit stopped it. With all three limits None it always ends by one of the former.
    """
    counts = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("a piece is longer than a sequence, or empty")
    best = best_fit(counts, capacity)
    best_bins, bound = sum(n for _, n in best), least_bins(counts, capacity)
    if best_bins <= bound:
        return best, "bound"
    total = sum(s * n for s, n in counts.items())
    stock, taken, used_bins, waste = Stock(counts), [], 0, 0
    met: dict[int, int] = {}  # least bins that each state was reached with
    cut_short = False

    def may_waste() -> int:
        return (best_bins - 1) * capacity - total - waste

    def options() -> Iterator[tuple[dict[int, int], tuple[int, ...], int, int]]:
        """Items, content, number and waste of each way to go on."""
        nonlocal cut_short
        found, whole = fillings(stock, stock.longest(capacity), capacity, may_waste(), steps, width)
        cut_short |= not whole
        ways = []
        for content in found:
            each, spare = Counter(content), capacity - sum(content)
            most = min(stock.n[s] // c for s, c in each.items())
            ways.append((each, content, min(most, may_waste() // spare) if spare else most, spare))
        yield from ways
        for each, content, most, spare in ways:
            if spare or len(content) != 2:  # two items that fill a bin dominate whatever else they are in
                yield from ((each, content, k, spare) for k in range(most - 1, 0, -1))

    stack = [options()]
    while stack:
        way = next(stack[-1], None)
        if way is None:
            stack.pop()
            if taken:
                each, n, spare, _ = taken.pop()
                used_bins -= n
                waste -= n * spare
                for s, c in each.items():
                    stock.put(s, c * n)
            continue
        if nodes is not None:
            if not nodes:
                return best, "nodes"
            nodes -= 1
        each, content, n, spare = way
        if n < 1 or n * spare > may_waste():
            continue
        for s, c in each.items():
            stock.take(s, c * n)
        taken.append((each, n, spare, content))
        used_bins += n
        waste += n * spare
        if not stock.live:
            best, best_bins = [(content, n) for _, n, _, content in taken], used_bins
            if best_bins <= bound:
                return best, "bound"
        if not stock.live or met.get(stock.state, used_bins + 1) <= used_bins:
            stack.append(iter(()))
        else:
            met[stock.state] = used_bins
            stack.append(options())
    return best, "fillings" if cut_short else "complete"


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODE_BUDGET, steps: int | None = FILL_STEPS, width: int | None = FILL_WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their numbers, as search_bins finds them."""
    return search_bins(counts, capacity, nodes, steps, width)[0]


class Layout:
    """Where the piece of a length and a rank goes: ranks of a length are cut into runs, one per pattern that has it."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], capacity: int):
        runs, places, first_sequence = [], [], 0
        reached: Counter = Counter()
        for content, n in plan:
            offset = 0
            starts: dict[int, list[int]] = {}
            for s in content:
                starts.setdefault(s, []).append(offset)
                offset += s
            for s, at in starts.items():
                runs.append((s, reached[s], first_sequence, len(at), len(places)))
                places += at
                reached[s] += len(at) * n
            first_sequence += n
        order = sorted(range(len(runs)), key=lambda i: runs[i][:2])
        table = np.array([runs[i] for i in order], dtype=np.int64).reshape(-1, 5)
        self.key = table[:, 0] * (1 << 50) + table[:, 1]
        self.rank, self.sequence, self.each, self.place = table[:, 1], table[:, 2], table[:, 3], table[:, 4]
        self.places = np.array(places, dtype=np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * (1 << 50) + rank, side="right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.each[at], self.places[self.place[at] + nth % self.each[at]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int | None = NODE_BUDGET, steps: int | None = FILL_STEPS, width: int | None = FILL_WIDTH) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), a table that is cheap to read again; limits as of search_bins."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    layout = spark.sparkContext.broadcast(Layout(plan_bins(histogram, capacity, nodes, steps, width), capacity))
    blocks = max(LEAST_BLOCKS, sum(histogram.values()) // BLOCK_ROWS)
    salted = pieces.withColumn("_block", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {blocks})"))
    before = salted.groupBy("length", "_block").agg(F.count("*").alias("_n")).select(
        "length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")).cast("long") - 1
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = layout.value(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, remembered: int = SMALL_CACHE_WORDS) -> DataFrame:
    """Pieces of docs (doc_id, text) with their sequence and offset; an empty table gives no rows."""
    return pack(staged(cut(docs, tokenizer or default_tokenizer(), remembered=remembered), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), remembered=CACHE_WORDS)
