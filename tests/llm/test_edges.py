"""Odd rows for every operator: nulls, empty and very long texts, repeated rows, clashing extra columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovespark.llm import blocks, decontam, fm, linerules, packing, pii, simhash, urllists, warc, wordpiece
from grovespark.llm.common import new_folder

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Some words that go on and on, with number %d, to make one very long text. "


@pytest.fixture(scope="module")
def docs(spark):
    words = "".join(LONG % i for i in range(9000))
    rows = [
        (1, "plain words of a short text that has just enough different words to pass the rule about twenty of them in a row, fine", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, words, "en", "a", len(words)),
        (4, words, "en", "a", len(words)),
        (5, " \n\t ", "en", "b", 3),
        (6, "x" * 200_000, "en", "b", 200_000),
        (None, "a row without an id but with enough words that it is kept by every rule that looks at words only, I hope so at least", "de", "b", 5),
        (7, "\x00 odd ́ marks \U0001f600 <|endoftext|> und ß É", "xx", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for extra in ("kept", "score", "length", "n", "key", "spans", "component_id", "fp", "sig", *"_id _doc _rows _words _key _kept _lost _hashes _n_words _again quality row met mark slot map id doc digest of by bucket node item_id".split()):
        df = df.withColumn(extra, F.lit("extra"))
    return df.withColumn("a.b", F.lit("extra")).withColumn("back`tick", F.lit("extra"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


BENCH = [(1, "words that go on and on"), (2, None), (3, ""), (4, "two words"), (1, "words that go on and on")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def test_per_document_operators_give_a_row_per_row(docs, none):
    machine = fm.Machine()
    for make in (lambda d: linerules.verdicts(d), lambda d: simhash.groups(d), lambda d: pii.detect(d), lambda d: wordpiece.token_counts(d), lambda d: fm.score(d, machine)):
        assert make(docs).count() == docs.count()
        assert make(none).count() == 0


def test_quality_rules_by_row(docs):
    out = {r["doc_id"]: r for r in linerules.verdicts(docs).collect()}
    assert out[1]["_kept"] and not out[2]["_kept"] and out[3]["_n_words"] == 0 and out[5]["_base_failed"]
    assert out[4]["_n_words"] == 16 * 9000 and out[6]["_word_chars"] == 200_000
    assert linerules.keep(docs).columns == linerules.cleaned(docs).columns == docs.columns
    assert {r["_kept"] for r in linerules.keep(docs).collect()} == {"extra"}


def test_groups(docs):
    out = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.groups(docs).collect()}
    assert {(i, 0, 2) for i in (2, 3, 5)} <= out
    kept = simhash.first_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4, 6, 7]


def test_decontamination(docs, none, bench):
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()} == {(4, 1)}
    assert decontam.drop_contaminated(docs, bench).count() == docs.count() - 2
    assert decontam.matches(none, bench).isEmpty() and decontam.matches(docs, bench.limit(0)).isEmpty()


def test_packing(docs, none):
    out = packing.pack_documents(docs).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [r["length"] for r in out if r["doc_id"] in (2, 3, 5)] == [1, 1, 1]
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none).isEmpty()


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a", None), (2, None, ""), (3, "x y\n", "<p>cut <b"), (None, "http://a", "<html>"), (4, "u", "y" * 300_000), (5, "u", "y" * 300_000), (5, "u", "y" * 300_000)], "page_id long, url string, html string").withColumn("text", F.lit("extra")).withColumn("digest", F.lit("extra"))
    assert blocks.extract(pages).count() == 7 and blocks.extract(pages.limit(0)).isEmpty()
    records = warc.with_revisits(pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")))
    back = warc.read_archives(warc.write_archives(records, new_folder(spark, "warc")), with_payload=True).collect()
    assert sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in back if r["payload_bytes"] > 1000) == [("urn:page:4", "revisit", "urn:page:5")] + [("urn:page:5", "response", None)] * 2
    assert len(back) == 7 and all(r["payload"] is None or len(r["payload"]) == r["payload_bytes"] for r in back)


def test_urls(spark):
    captures = spark.createDataFrame([(1, None, "2024-01-05"), (2, "no url", "2024-01-05"), (3, "http://U:p@WWW.Bad.example.com.:80/x", "2024-01-05"), (3, "http://www.bad.example.com/", None), (4, "http://bad.example.com", "2024-01-09"), (None, "http://good.example.com", "2024-01-05")], "page_id long, url string, day string").withColumn("day", F.col("day").cast("date")).withColumn("term", F.lit(1))
    entries = spark.createDataFrame([("bad.example.com", "spam", "add", "2024-01-01"), ("bad.example.com", "spam", "add", "2024-01-02"), ("bad.example.com", "spam", "remove", "2024-01-09"), (None, "spam", "add", "2024-01-01"), ("x", None, "add", "2024-01-01")], "domain string, list string, action string, day string").withColumn("day", F.col("day").cast("date"))
    out = sorted((r["page_id"] or 0, str(r["day"]), r["blocked"], str(r["since"])) for r in urllists.judge(captures, entries).collect())
    assert out == [(0, "2024-01-05", False, "None"), (1, "2024-01-05", False, "None"), (2, "2024-01-05", False, "None"), (3, "2024-01-05", True, "2024-01-01"), (3, "None", False, "None"), (4, "2024-01-09", False, "None")]
    assert urllists.judge(captures.limit(0), entries).isEmpty() and urllists.judge(captures, entries.limit(0)).count() == 6


def test_training_without_labels(docs, none, spark):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    machine = fm.train(docs, labels)
    assert {r["score"] for r in fm.score(docs, machine).collect()} == {0.5}


def test_training_on_repeated_rows(docs, spark, monkeypatch):
    """A row of each doc_id is learnt from, however often it is repeated or relabelled."""
    seen = []
    monkeypatch.setattr(fm.Machine, "fit", lambda self, rows, labels: seen.append((len(rows), list(labels))))
    ids = [r[0] for r in spark.range(1, 8).where(~fm.held_out(F.col("id"))).collect()]
    labels = spark.createDataFrame([(i, q) for i in ids for q in (0, 0, i % 2)], "doc_id long, quality int").withColumn("text", F.lit("extra"))
    fm.train(docs.unionByName(docs), labels)
    assert seen == [(len(ids), [float(i % 2) for i in ids])]


def test_url_lists_with_clashing_names(spark):
    day = F.lit("2024-01-05").cast("date")
    captures = spark.createDataFrame([(1, "http://bad.example.com/")], "page_id long, url string").withColumn("day", day)
    entries = spark.createDataFrame([("bad.example.com", "spam", "add")], "domain string, list string, action string").withColumn("day", day)
    for extra in ("host", "blocked", "since", "until", "rank", "term", "_was", "page_id", "url"):
        entries = entries.withColumn(extra, F.lit("extra"))
    for extra in ("domain", "list", "since", "host", "blocked", "rank", "_was"):
        captures = captures.withColumn(extra, F.lit("extra"))
    assert [r["blocked"] for r in urllists.judge(captures, entries).collect()] == [True]


def test_pipeline_stages_keep_columns(spark, docs, none, tmp_path, bench):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count()
