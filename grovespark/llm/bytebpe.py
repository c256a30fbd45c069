"""Byte-level BPE encoding and decoding, with the ids that the rank file's own library gives.

Distinct pre-tokens are laid, by length, into padded numpy matrices of token ids. In each round every
row merges its leftmost pair of least rank: the two ids become one, the row moves up, and the two pairs
that changed are looked up in a hash table of all pairs that form a token. Rows without such a pair are
done and leave the matrix. Pre-tokens too long for a matrix are merged with a heap, to the same ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, table

#: Pre-tokens of more bytes than this are merged one by one, with a heap.
WIDEST = 256
#: Cells of one matrix.
CELLS = 1 << 20
#: Pre-tokens whose ids a Python worker remembers, and the characters of the longest of them.
CACHE_WORDS = 400_000
CACHE_CHARS = 64
#: Characters of a text, and pre-tokens, that are handled at a time.
PART_CHARS = 1 << 20
PART_WORDS = 100_000

#: Rank of what is no pair.
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Token id of a pair of ids, by open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, (4 * len(merged)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)  # one of the keys that meet takes the slot
            put = free[first]
            self.keys[slot[put]], self.ids[slot[put]] = keys[put], merged[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, merged, slot = keys[rest], merged[rest], slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs, _NONE where they form no token."""
        keys = left.astype(np.int64) << 32 | right
        out, slot = np.full(len(keys), _NONE, np.int32), self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.ids[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], slot[on] + 1 & self.mask
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path}: bytes without a rank")
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        found = [(a, b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        self.pair_of = {(a, b): i for a, b, i in found}
        self.pairs = PairTable(*np.array(found, np.int64).reshape(-1, 3).T.astype(np.int32))
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in parts."""
        if len(text) <= PART_CHARS:
            yield self.pattern.findall(text)
            return
        each = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(each, PART_WORDS)):
            yield part

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each of these pre-tokens."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        buckets: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:  # a token as it stands, though merges might not reach it
                out[k] = np.array([whole], np.int32)
            elif len(word) > WIDEST:
                out[k] = self._merge_one(word)
            elif word:
                buckets.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(k)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                for k, ids in zip(some, self._merge_rows([words[k] for k in some], width)):
                    out[k] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        n = np.fromiter(map(len, words), np.int64, len(words))
        column = np.arange(width)
        ids = np.where(column < n[:, None], self.byte[flat], -1).astype(np.int32)
        ranks = np.full(ids.shape, _NONE, np.int32)
        row, at = np.nonzero(column + 1 < n[:, None])
        ranks[row, at] = self.pairs.find(ids[row, at], ids[row, at + 1])
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        name = np.arange(len(words))
        while len(name):
            place = ranks.argmin(axis=1)  # the first of the least
            best = ranks[np.arange(len(name)), place]
            if (done := best == _NONE).any():
                for k in np.flatnonzero(done):
                    out[name[k]] = ids[k, : n[k]].copy()
                wide = int(n[~done].max(initial=1))  # rows that are done leave, and columns that none fills
                name, n, place, best, ids, ranks = name[~done], n[~done], place[~done], best[~done], ids[~done, :wide], ranks[~done, :wide]
                if not len(name):
                    break
            each, column = np.arange(len(name)), np.arange(ids.shape[1])
            ids[each, place] = best
            source = np.minimum(column + (column > place[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            n -= 1
            past = column >= n[:, None]
            ids[past] = -1
            ranks[past] = _NONE
            ranks[each, n - 1] = _NONE
            left = place > 0
            ranks[each[left], place[left] - 1] = self.pairs.find(ids[each[left], place[left] - 1], best[left])
            right = place + 1 < n
            ranks[each[right], place[right]] = self.pairs.find(best[right], ids[each[right], place[right] + 1])
        return out

    def _merge_one(self, word: bytes) -> np.ndarray:
        """The same merges of one long pre-token: a heap of (rank, place), places linked to their neighbours."""
        n, get = len(word), self.pair_of.get
        ids = array("i", self.byte[np.frombuffer(word, np.uint8)].tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap = [r << 32 | k for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = (x := heapq.heappop(heap)) >> 32, x & 0xFFFFFFFF
            if ids[k] < 0 or (right := after[k]) >= n or get((ids[k], ids[right])) != rank:
                continue  # one of the two has been merged since
            ids[k], ids[right] = rank, -1
            after[k] = on = after[right]
            if on < n:
                before[on] = k
                if (r := get((rank, ids[on]))) is not None:
                    heapq.heappush(heap, r << 32 | k)
            if (to := before[k]) >= 0 and (r := get((ids[to], rank))) is not None:
                heapq.heappush(heap, r << 32 | to)
        found = np.frombuffer(ids, np.int32)
        return found[found >= 0].copy()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, 32 bits each."""
        known, out = self.known, []
        parts: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            new = list({w for _, words in parts for w in words}.difference(known))
            for word, ids in zip(new, self.merge([w.encode() for w in new])):
                known[word] = ids.tobytes()
            for k, words in parts:
                out[k].append(b"".join(map(known.__getitem__, words)))
            full = len(known) > CACHE_WORDS  # words met early are the frequent ones and stay
            for word in new:
                if full or len(word) > CACHE_CHARS:
                    del known[word]
            parts.clear()

        for k, text in enumerate(texts):
            out.append([])
            for words in self.words(text):
                parts.append((k, words))
                if (held := held + len(words)) > PART_WORDS:
                    flush()
                    held = 0
        flush()
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of these ids; an id without a token is an error."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"no token has the id {e}") from None


    @functools.cached_property
    def laid_out(self) -> pa.Array:
        """Tokens by id, null where there is none."""
        return pa.array(list(map(self.tokens.get, range(max(self.tokens) + 1))), pa.large_binary())

    def decode_lists(self, lists: pa.ListArray) -> list[bytes | None]:
        """decode() of each list of ids; null for null. Tokens taken in a row lie together as the bytes of their texts."""
        ids, ends = lists.values, lists.offsets.to_numpy()
        if len(ids) and not (0 <= pc.min(ids).as_py() and pc.max(ids).as_py() < len(self.laid_out)):
            raise ValueError("no token has some of these ids")
        taken = self.laid_out.take(ids)
        if taken.null_count:
            raise ValueError("no token has some of these ids")
        _, places, data = taken.buffers()
        at = (np.frombuffer(places, np.int64, len(taken) + 1, 8 * taken.offset) if places else np.zeros(1, np.int64))[ends]
        whole = memoryview(data) if data else b""
        return [bytes(whole[a:b]) if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), lists.is_valid().to_pylist())]


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs (doc_id, text); ranks is the path of a rank file.

    Null and empty texts have no ids; rows that repeat a doc_id, or have none, give a row each.
    """
    path = ranks or default_ranks()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = codec(path).encode([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of the ids of each row of encoded (doc_id, ids); null ids give null."""
    path = ranks or default_ranks()
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = codec(path).decode_lists(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
