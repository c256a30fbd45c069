"""Source divergence, byte-level BPE and ranked search: brute force, the rank file's own library, odd rows, blocks and small limits."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovespark.llm import bytebpe, divergence, lexical
from grovespark.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Straße", "été", "x", "日本", "don't", "a1b"]
    rows = [(k, " ".join(rng.choices(words[: 3 + k % 7], k=rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""]), 1) for k in range(150)]
    rows += [
        (150, None, "en", "s1", None), (151, "", "xx", "s1", 0), (152, " \n\t", "xx", "s2", 3), (153, "alpha " * 200_000, "en", "s2", 1), (153, "alpha beta", "en", "s2", 1),
        (153, "alpha beta", "en", "s2", 1), (None, "beta gamma", "de", "s9", 1), (None, "beta gamma", "de", "s9", 1), (154, "y" * 300_000, "en", "lone", 1), (155, "only one", "zz", "only", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for extra in "term count docs block p q n v value rank ids decoded item_id number score salt bucket terms".split():
        df = df.withColumn(extra, F.lit("extra"))
    return df.repartition(3)


def brute_divergence(rows, min_docs):
    out, df, count, groups = [], Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = divergence.terms_of(text)
        groups[lang].add(source)
        df.update((lang, t) for t in set(terms))
        count[lang, source].update(terms)
    for lang, sources in groups.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        total = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})

        def p(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(count[lang, s]) for s in sources}, p(total)
        for s in sources:
            pairs = sorted(((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-f(of[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and of[s][t] > q[t])[:10]
            out += [(lang, s, part, x.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found, 1)]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [500_000, 3])
def test_divergence_equals_brute_force(docs, block):
    rows = [(r["lang"] or "", r["source"] or "", r["text"]) for r in docs.collect()]
    assert plain(divergence.divergence(docs, block_terms=block)) == brute_divergence(rows, 10)
    assert plain(divergence.divergence(docs, min_docs=10**6)) == brute_divergence(rows, 10**6)


def test_divergence_in_small_parts(docs, monkeypatch):
    want = plain(divergence.divergence(docs))
    for name in ("GATHERED", "COUNT_CELLS", "COUNT_TERMS", "MATRIX_CELLS"):
        monkeypatch.setattr(divergence, name, 5)
    assert plain(divergence.divergence(docs)) == want


def test_no_documents(docs):
    none = docs.limit(0)
    assert plain(divergence.divergence(none)) == []
    assert plain(bytebpe.decode(bytebpe.encode(none))) == []
    items = docs.sparkSession.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert plain(lexical.search(lexical.index(none), items)) == []
    assert plain(lexical.search(lexical.index(docs), items.limit(0))) == []


def test_p_is_exact_for_counts_of_any_size(spark):
    count, n = 10**15 + 7, 10**17 + 3
    got = spark.range(1).select(divergence._p(F.lit(count), F.lit(n), F.lit(10**9))).first()[0]
    assert got == 1 + 10**9 * (count + 2) // (n + 2 * 10**9)


def test_terms_inside_others_are_not_found():
    found = divergence.TermAutomaton(["a", "ab", "b", "été"])
    assert found.find([b"A ab,a-b abab", "\xe9t\xe9 d’\xe9t\xe9".encode()]).tolist() == [0, 1, 0, 2, 3]
    assert found.find([]).tolist() == divergence.TermAutomaton([]).find([b"a"]).tolist() == []


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers
    import tiktoken

    path = bytebpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bytebpe.codec(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.one_of(st.text(max_size=80), st.text("ab", max_size=400), st.text("eé日 \n1", max_size=120)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library(codecs, texts):
    own, library = codecs
    got = own.encode(texts)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(x.tolist()) for x in got] == [t.encode() for t in texts]


def test_long_pre_tokens_and_small_parts(codecs, monkeypatch):
    own, library = codecs
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcde", k=n)) for n in (255, 256, 257, 5000)] + ["a" * 20_000, "word " * 5000, "<|endoftext|>"]
    want = [library.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == want
    monkeypatch.setattr(bytebpe, "PART_CHARS", 100)
    monkeypatch.setattr(bytebpe, "PART_WORDS", 7)
    monkeypatch.setattr(bytebpe, "CACHE_WORDS", 0)
    monkeypatch.setattr(bytebpe, "CELLS", 1)
    assert [x.tolist() for x in own.encode(texts)] == want
    with pytest.raises(ValueError):
        own.decode([10**6])


def test_bpe_query(spark, docs, codecs):
    library = codecs[1]
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    for r in bytebpe.query(spark, SF).collect():
        ids = library.encode_ordinary(texts.pop(r["doc_id"]) if r["doc_id"] in texts else None)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest()
    assert not texts
    got = bytebpe.decode(bytebpe.encode(docs)).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((r["text"] or "").encode() for r in docs.collect())
    assert bytebpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["decoded"] is None


def brute_search(rows, items, top=20):
    bags = [(doc_id, Counter(lexical.terms_of(text))) for doc_id, text in rows]
    bags = [(d, b) for d, b in bags if b]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, b in bags:
            m = 75 + 25 * sum(b.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in lexical.terms_of(text) if b[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta beta GAMMA"), (1, "alpha beta beta GAMMA"), (1, "x"), (2, None), (3, ""), (4, "nowhere"), (5, "straße 日本 a1b don t"), (None, "gamma")]


def test_search_equals_brute_force(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("extra"))
    want = brute_search(rows, [x for x in ITEMS if x[1] is not None])
    assert sorted((tuple(r) for r in lexical.search(lexical.index(docs), items).collect()), key=str) == want
    for name, value in (("SEGMENT_DOCS", 7), ("SEGMENT_TERMS", 60), ("FILE_SEGMENTS", 2), ("BLOCK_ITEMS", 2), ("SALT", 3)):
        monkeypatch.setattr(lexical, name, value)
    segments = lexical.index(docs)
    assert segments.count() > 20
    assert sorted((tuple(r) for r in lexical.search(segments, items).collect()), key=str) == want
    few = brute_search(rows, [x for x in ITEMS if x[1] is not None], 3)
    assert sorted((tuple(r) for r in lexical.search(segments, items, 3).collect()), key=str) == few


def test_windows_and_ties(monkeypatch):
    """Equal scores over many windows: the least ids win."""
    segment = lexical._Segment()
    for k in range(100, 0, -1):
        segment.add(k, [b"a"])
    row = segment.row().to_struct_array()[0]
    monkeypatch.setattr(lexical, "WINDOW", 8)
    postings = lexical._Postings(row, lexical.pa.array(["a"]), lexical.np.array([5]), 100, 100)
    heap = []
    for w in reversed(range(postings.windows)):
        places, parts, met = postings.of[0][w]
        assert lexical.np.flatnonzero(lexical.np.unpackbits(met)).tolist() == places.tolist()
        lexical._harvest(heap, 5, places, parts, postings.doc_ids, w * 8)
    assert sorted(-no for _, _, no in heap) == [1, 2, 3, 4, 5]


def test_lists_of_ids_are_decoded_together():
    import pyarrow as pa

    from grovespark.llm import bytebpe

    codec = bytebpe.codec(bytebpe.default_ranks())
    lists = [codec.encode([t])[0].tolist() for t in ("one two", "", "grüße \U0001f600 " * 50)]
    column = pa.array([[5], *lists, None, []], pa.list_(pa.int32())).slice(1)
    assert codec.decode_lists(column) == [*map(codec.decode, lists), None, b""]
    assert codec.decode_lists(pa.array([], pa.list_(pa.int32()))) == []
    for wrong in (-1, max(codec.tokens) + 1):
        with pytest.raises(ValueError):
            codec.decode_lists(pa.array([[wrong]], pa.list_(pa.int32())))
