"""Word-piece counts of texts by a linear longest-match automaton.

The trie of the vocabulary has a failure link and a count of popped tokens at each node, so one pass
over the bytes of a word gives the number of greedy longest pieces without building any of them
(Song et al., Fast WordPiece Tokenization, 2021).
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, table

#: Words whose counts a Python worker remembers.
CACHE_WORDS = 500_000


def byte_of() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes, special ones left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special, to = {x["content"] for x in model.get("added_tokens", [])}, byte_of()
    return [bytes(to[c] for c in t) for t in model["model"]["vocab"] if t not in special]


class Automaton:
    """Greedy longest-match counts over a set of byte strings; None for what no sequence of them covers."""

    def __init__(self, tokens: list[bytes]):
        step: dict[int, int] = {}  # node * 256 + byte
        ends, parent = [False], [(0, 0)]
        for token in tokens:
            node = 0
            for b in token:
                if (to := step.get(node * 256 + b)) is None:
                    to = step[node * 256 + b] = len(ends)
                    ends.append(False)
                    parent.append((node, b))
                node = to
            ends[node] = True
        children: list[list[int]] = [[] for _ in ends]
        for node in range(1, len(ends)):
            children[parent[node][0]].append(node)
        fail, popped = [-1] * len(ends), [0] * len(ends)
        todo = deque(children[0])
        while todo:
            node = todo.popleft()
            todo.extend(children[node])
            if ends[node]:
                fail[node], popped[node] = 0, 1
                continue
            up, b = parent[node]
            back, n = fail[up], popped[up]
            while back >= 0 and back * 256 + b not in step:
                n += popped[back]
                back = fail[back]
            if back >= 0:
                fail[node], popped[node] = step[back * 256 + b], n
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int | None:
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for b in word:
            while (to := step.get(node * 256 + b)) is None:
                if fail[node] < 0:
                    return None
                n += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return None
            n += popped[node]
            node = fail[node]
        return n


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word_tokens) of each row of docs (doc_id, text).

    A word is a run of what is not ASCII white space; its pieces cover a space and its bytes. A word
    that no sequence of pieces covers, which longest matches cannot go on in, is one unknown piece, as in
    WordPiece. Null and empty texts count zero.
    """
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton(path).count, {}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "replace").split()
                new = set(words).difference(known)
                for w in new:
                    known[w] = count(b" " + w) or 1  # none covers it: one unknown piece
                counts = list(map(known.__getitem__, words))
                if len(known) > CACHE_WORDS:  # words met early are the frequent ones and stay
                    for w in new:
                        del known[w]
                rows.append((len(words), sum(counts), max(counts, default=0)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
