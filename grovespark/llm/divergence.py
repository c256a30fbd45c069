"""Source divergence audit: how far the vocabulary of each source of a language is from the others'.

Two passes over the texts. The first counts, exactly, in how many documents of its language each term
stands. The second is an Aho-Corasick automaton over the kept terms, each between two delimiters, that
recounts their occurrences in the normalised texts. The counts are sparse postings (lang, source, term);
p of a count, smoothed and scaled to whole numbers, is compared between every two sources of a language
and between a source and its language.

Kept terms go to the automaton in blocks of BLOCK_TERMS, so its memory has a bound at any size of the
vocabulary: each block reads the documents of its own languages once.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, small, staged, table

#: Documents of a language that a kept term stands in.
MIN_DOCS = 10
#: Ranks of the terms of a source.
TOP_TERMS = 10
#: p of a term that makes up a whole source.
SCALE = 1_000_000_000
#: Terms of one automaton, on average at most (some 150 bytes each in every worker).
BLOCK_TERMS = 500_000
#: Distinct terms, or counts, that a worker gathers before it sends them on.
GATHERED = 400_000
COUNT_CELLS = 16_000_000
#: Occurrences that a worker counts before it sends the counts on, so that 32 bits hold them.
COUNT_TERMS = 1 << 30
#: Cells (source, term) of one matrix of the pair sums.
MATRIX_CELLS = 1 << 18

#: Bytes of a normalised text: A-Z in lower case; ASCII letters and all bytes from 128 on stay, the rest are delimiters.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, in order."""
    return [t.decode() for t in (text or "").encode("utf-8", "replace").translate(_NORMAL).split()]


def _text_rows(docs: DataFrame) -> DataFrame:
    """(lang, source, text) of docs without nulls, text as UTF-8 bytes."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): the documents of each language that hold each term, for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                cols = [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "term", "docs"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found[lang].update(set(text.translate(_NORMAL).split()))
            if sum(map(len, found.values())) > GATHERED:
                yield from sent()
        yield from sent()

    bounded_batches(docs.sparkSession)
    parts = _text_rows(docs).select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
    return parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


class TermAutomaton:
    """Occurrences of terms in normalised texts; terms are found between two delimiters only, so never inside others."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms, self.found = terms, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(terms):
            self.found.add_word(f" {term} ", k)
        if terms:
            self.found.make_automaton()

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The number of the term of each occurrence in these texts, one after the other."""
        if not self.terms:
            return np.zeros(0, np.int64)
        # one delimiter between two terms serves both of them
        line = b" ".join([b"", *(t.translate(_NORMAL) for t in texts), b""]).decode("utf-8", "replace")
        return np.fromiter(map(itemgetter(1), self.found.iter(line)), np.int64)


#: The automata of one block, by language, that this worker has built; those of an earlier block are let go.
_built: dict[str, dict[str, TermAutomaton]] = {}


def _automata(name: str) -> dict[str, TermAutomaton]:
    if name not in _built:
        _built.clear()
        _built[name] = {}
    return _built[name]


def _recounted(rows: DataFrame, block: dict[str, list[str]]) -> DataFrame:
    """(lang, source, term, count) of the terms of a block, by language, over the rows of its languages."""
    shared, name = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex  # of BLOCK_TERMS terms on average

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, met = _automata(name), 0
        counts: dict[tuple[str, str], np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), all_of in counts.items():
                some = np.flatnonzero(all_of)
                terms = pa.array(automata[lang].terms, pa.string()).take(pa.array(some))
                cols = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), terms, pa.array(all_of[some].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "count"])
            counts.clear()

        for batch in batches:
            groups: dict[tuple[str, str], list[bytes]] = defaultdict(list)
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                groups[lang, source].append(text)
            for key, texts in groups.items():
                if key[0] not in automata:
                    automata[key[0]] = TermAutomaton(shared.value[key[0]])
                if key not in counts:
                    counts[key] = np.zeros(len(automata[key[0]].terms), np.int32)
                found = automata[key[0]].find(texts)
                np.add.at(counts[key], found, 1)
                met += len(found)
            if met > COUNT_TERMS or sum(map(len, counts.values())) > COUNT_CELLS:
                yield from sent()
                met = 0
        yield from sent()

    some = rows.where(F.col("lang").isin(sorted(block)))
    parts = some.mapInArrow(run, "lang string, source string, term string, count long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, term, block): terms in min_docs documents of their language; blocks follow each other language by language."""
    kept = staged(document_frequencies(docs).where(F.col("docs") >= min_docs).select("lang", "term"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)  # a row for each language
    sizes = small(sizes.withColumn("before", F.coalesce(F.sum("v").over(before), F.lit(0))), "sizes")
    # a term's place within its language is drawn from its hash: no sort, and blocks of about the same size
    place = F.col("before") + F.floor(F.col("v") * (F.pmod(F.xxhash64("term"), F.lit(1 << 20)) / (1 << 20)))
    return kept.join(sizes, "lang").select("lang", "term", F.floor(place / block_terms).cast("int").alias("block"))


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, count): occurrences of kept terms, those above none; kept has (lang, term, block)."""
    bounded_batches(docs.sparkSession)
    rows = _text_rows(docs)
    out = None
    for k in range((kept.agg(F.max("block")).first()[0] or 0) + 1):
        block: dict[str, list[str]] = defaultdict(list)
        for lang, term in kept.where(F.col("block") == k).select("lang", "term").collect():
            block[lang].append(term)
        part = staged(_recounted(rows, dict(block)), "postings")
        out = part if out is None else out.unionAll(part)
    return out


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 * v)), exact for any counts; null where there is neither a count nor a term."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2)
    return 1 + F.call_function("div", top, F.nullif(whole(n + 2 * v), F.lit(0).cast("decimal(19,0)")))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value), a before b: sums over the terms of one bucket. Rows without a term give the p of no occurrence of each source."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    has = pc.is_valid(rows.column("term"))
    none, some = rows.filter(pc.invert(has)), rows.filter(has)
    sources = sorted(none.column("source").to_pylist())
    at = {s: k for k, s in enumerate(sources)}
    base = np.zeros(len(sources), np.int64)
    base[[at[s] for s in none.column("source").to_pylist()]] = none.column("p").to_numpy()
    terms = some.column("term").combine_chunks().dictionary_encode() if len(some) else None
    width = len(terms.dictionary) if terms is not None else 0
    p = np.repeat(base[:, None], width, axis=1)
    if width:
        p[[at[s] for s in some.column("source").to_pylist()], terms.indices.to_numpy()] = some.column("p").to_numpy()
    for k in range(len(sources) - 1):
        apart = p[k] - p[k + 1 :]
        value = (apart * apart // (p[k] + p[k + 1 :])).sum(axis=1) if width else np.zeros(len(sources) - k - 1, np.int64)
        cols = [pa.array([key[0].as_py()] * len(value), pa.string()), pa.array([sources[k]] * len(value), pa.string()), pa.array(sources[k + 1 :], pa.string()), pa.array(value, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text).

    Part 'pair' ranks, for each source of a language, all its other sources by the sum of f over the
    kept terms; part 'term' its top_terms kept terms that are more frequent than in the language. Null
    lang, source and text are ''. Empty texts, and groups without any term, count as groups; repeated
    rows count as often as they stand; a language with one source has no pairs; no rows give no rows.
    """
    kept = staged(kept_terms(docs, min_docs, block_terms), "blocks")
    counts = postings(docs, kept)
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = small(kept.groupBy("lang").agg(F.count("*").alias("v")), "vocabulary")
    occurring = _text_rows(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    groups = occurring.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n", "v"])
    groups = small(groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang"))), "groups")
    with_p = staged(counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("count"), F.col("n"), F.col("v"))), "frequencies")

    buckets = F.ceil(F.col("v") * F.col("sources") / MATRIX_CELLS).cast("int")
    bucket = F.pmod(F.xxhash64("term"), F.greatest(buckets, F.lit(1))).cast("int")
    posted = with_p.select("lang", bucket.alias("bucket"), "source", "term", "p")
    absent = F.coalesce(_p(F.lit(0).cast("long"), F.col("n"), F.col("v")), F.lit(1))
    every = groups.select("lang", F.explode(F.sequence(F.lit(0), F.greatest(buckets, F.lit(1)) - 1)).alias("bucket"), "source", F.lit(None).cast("string").alias("term"), absent.alias("p"))
    sums = posted.unionAll(every).groupBy("lang", "bucket").applyInArrow(_pair_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = sums.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    whole = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"))
    size = small(counts.groupBy("lang").agg(F.sum("count").alias("all")).join(vocabulary, "lang"), "languages")
    language = whole.join(size, "lang").select("lang", "term", _p(F.col("total"), F.col("all"), F.col("v")).alias("q"))
    high = with_p.join(language, ["lang", "term"]).where("p > q")
    terms = high.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources and the ten leading terms of each, over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
l AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)))::BIGINT AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v))::BIGINT AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
WHERE part = 'pair' OR rank <= 10
"""
