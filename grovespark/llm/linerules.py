"""Quality rules: word counts and repeats of each text, and lines that too many documents of a host share.

DataFrame functions only. A document is a row: rows that repeat count like any other copies, and
copies of one text on one host count once, so that copying alone makes no line frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import own, staged, table

MIN_WORDS = 20
#: Percent of words in repeated windows above which a text fails.
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line in more distinct texts of a host than this many, and than this percent of them, is removed from all but its first document.
MAX_DOCS_PER_LINE = 5
MAX_PERCENT_PER_LINE = 2
#: A document is depleted if fewer percent of its words than this survive the removal.
MIN_SURVIVING_PERCENT = 60

_BASE = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def _lines(text: Column) -> Column:
    """Normalised lines, lower case with single spaces; as many as the text has, so those without a word are empty."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "))
    return F.split(flat, " ?\n ?")


def base(docs: DataFrame) -> DataFrame:
    """Add _words, _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words and _base_failed to docs (text).

    Each step is a column of its own, so nothing is computed twice. Windows are compared by the
    64-bit hash of their words' hashes; only texts where a hash repeats sort their windows. A null
    text is an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.withColumn("_words", _words(text)).withColumn("_n_words", F.size("_words").cast("long"))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    starts = F.when(F.col("_n_words") >= WINDOW, F.sequence(F.lit(0), F.col("_n_words").cast("int") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    sorted_windows = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = F.array_sort(
        F.transform(
            F.filter("_sorted", lambda x, i: (F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"]))),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        F.transform("_found", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_found", i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    steps = (
        with_words.withColumn("_word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("_n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("_with_word", lines)
        .withColumn("_n_dup_lines", (F.size("_with_word") - F.size(F.array_distinct("_with_word"))).cast("long"))
        .drop("_with_word")
        .withColumn("_hashes", hashes)
        .withColumn("_windows", windows)
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_windows))
        .withColumn("_found", F.when(F.col("_sorted").isNotNull(), found))
        .withColumn("_n_repeat_words", F.when(F.col("_found").isNull(), F.lit(0).cast("long")).otherwise(covered))
        .withColumn("_base_failed", (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words")))
    )
    # a generator of one row: filters on its columns stay above it, instead of computing each step anew for each use
    return steps.select(*docs.columns, F.inline(F.array(F.struct(*_BASE))))


def frequent_lines(docs: DataFrame, limit: int = MAX_DOCS_PER_LINE, percent: int = MAX_PERCENT_PER_LINE) -> DataFrame:
    """Lines of docs (doc_id, text, source) in more than limit distinct texts, and percent of the distinct texts, of a host: (_line, _first).

    _line hashes host and normalised line; _first is the least doc_id among its texts. Equal texts of
    a host meet first, by a partial aggregate, as an array of hashes; then each line adds one row, and
    each text one for its host (no line), summed before the shuffle, so a host or line with a third of
    the rows costs one row a task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    host = F.coalesce(F.col("source"), F.lit(""))
    hashed = docs.select(
        F.col("doc_id").alias("_doc"),
        F.xxhash64(host).alias("_host"),
        F.xxhash64(text).alias("_t1"),
        F.struct(F.hash(text), F.length(text)).alias("_t2"),
        F.array_distinct(F.transform(F.array_remove(_lines(text), ""), lambda x: F.xxhash64(host, x))).alias("_lines"),
    )
    texts = hashed.groupBy("_host", "_t1", "_t2").agg(F.min("_doc").alias("_doc"), F.first("_lines").alias("_lines"))
    each = texts.select("_host", "_doc", F.explode(F.array_append("_lines", F.lit(None).cast("long"))).alias("_line"))
    counts = each.groupBy("_host", "_line").agg(F.count("*").alias("_n"), F.min("_doc").alias("_first"))
    counts = staged(counts.where((F.col("_n") > limit) | F.col("_line").isNull()), "lines")
    hosts = counts.where("_line IS NULL").select("_host", F.col("_n").alias("_texts"))
    return counts.where(F.col("_line").isNotNull()).join(hosts, "_host").where((F.col("_n") > limit) & (100 * F.col("_n") > percent * F.col("_texts"))).select("_line", "_first")


def _removed(docs: DataFrame, limit: int, percent: int) -> DataFrame:
    """(_doc, _host, _text, _at, _n): the lines that each document loses, by their place, with their words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    host = F.coalesce(F.col("source"), F.lit(""))
    count = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int")
    every = F.transform(_lines(text), lambda x, i: F.struct(i.alias("at"), F.when(x != "", F.xxhash64(host, x)).alias("line"), count(x).alias("words")))
    lines = docs.select(
        F.col("doc_id").alias("_doc"),
        host.alias("_host"),
        F.xxhash64(text).alias("_text"),
        F.explode(F.filter(every, lambda x: x["line"].isNotNull())).alias("_x"),
    ).select("_doc", "_host", "_text", F.col("_x.at").alias("_at"), F.col("_x.line").alias("_line"), F.col("_x.words").alias("_n"))
    hit = lines.join(frequent_lines(docs, limit, percent), "_line").where(~F.col("_doc").eqNullSafe(F.col("_first")))
    # rows that repeat a document count each of their lines once, by its place
    return hit.groupBy("_doc", "_host", "_text", "_at").agg(F.max("_n").alias("_n"))


def lost_words(docs: DataFrame, limit: int = MAX_DOCS_PER_LINE, percent: int = MAX_PERCENT_PER_LINE) -> DataFrame:
    """Words that each document loses with its frequent lines, and the places of these: (_doc, _host, _text, _lost, _gone), documents that lose any.

    The first document that has a line keeps it. Documents are told apart by id, host and text hash.
    """
    return _removed(docs, limit, percent).groupBy("_doc", "_host", "_text").agg(F.sum("_n").alias("_lost"), F.collect_list("_at").alias("_gone"))


def _judged(docs: DataFrame, limit: int, percent: int) -> DataFrame:
    """(row, what base() and the lines say): each document whole in one column, so that no name of its own can clash."""
    packed = docs.select(F.struct(*own(docs)).alias("row"), "doc_id", "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = base(packed).withColumn("_key", F.struct(F.coalesce(F.col("source"), F.lit("")).alias("h"), F.xxhash64(text).alias("t")))
    depleted = F.coalesce(100 * (F.col("_n_words") - F.col("_lost")) < MIN_SURVIVING_PERCENT * F.col("_n_words"), F.lit(False))
    lost = lost_words(docs.select("doc_id", "text", "source"), limit, percent)
    on = rules["doc_id"].eqNullSafe(lost["_doc"]) & (rules["_key"]["h"] == lost["_host"]) & (rules["_key"]["t"] == lost["_text"])
    return rules.join(lost, on, "left").withColumn("_kept", ~F.col("_base_failed") & ~depleted)


def verdicts(docs: DataFrame, limit: int = MAX_DOCS_PER_LINE, percent: int = MAX_PERCENT_PER_LINE) -> DataFrame:
    """docs with the columns of base(), _lost (null: nothing) and _kept; columns of docs that have one of these names are replaced."""
    names = [*_BASE, "_lost", "_kept"]
    own = [c for c in docs.columns if c.lower() not in names]
    return _judged(docs, limit, percent).select(*(F.col("row")[c].alias(c) for c in own), *names)


def keep(docs: DataFrame, limit: int = MAX_DOCS_PER_LINE, percent: int = MAX_PERCENT_PER_LINE) -> DataFrame:
    """The documents that pass, with their own columns as they are."""
    return _judged(docs, limit, percent).where("_kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def cleaned(docs: DataFrame, limit: int = MAX_DOCS_PER_LINE, percent: int = MAX_PERCENT_PER_LINE) -> DataFrame:
    """The documents that pass, with their own columns, their frequent lines taken out of text; a null text stays null."""
    left = F.array_join(F.filter(F.split(F.col("row")["text"], "\n"), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i)), "\n")
    out = F.when(F.col("_gone").isNull(), F.col("row")["text"]).otherwise(left)
    return _judged(docs, limit, percent).where("_kept").select(*((out if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. Null texts have no words and fail; a null source is a host of its own; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    ready = verdicts(docs)
    return ready.select("doc_id", *(F.col(f"_{c}").alias(c) for c in names), F.coalesce("_lost", F.lit(0)).cast("long").alias("lost_words"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(regexp_split_to_array(coalesce(text, ''), '\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, unnest(list_transform(range(len(words) - 7), lambda i: {'i': i, 's': list_slice(words, i + 1, i + 8)}), recursive := true)
  FROM d WHERE len(words) >= 8),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM w),
c AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM r WHERE n > 1),
rep AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
n AS (
  SELECT doc_id, host, text, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' '), ' ?\n ?'), lambda x: x <> '')) AS line
  FROM d),
h AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
f AS (SELECT host, line, min(doc_id) AS first FROM n JOIN h USING (host) GROUP BY host, line, texts HAVING count(DISTINCT text) > 5 AND 100 * count(DISTINCT text) > 2 * texts),
lost AS (
  SELECT doc_id, sum(len(line) - len(replace(line, ' ', '')) + 1)::BIGINT AS lost_words
  FROM n JOIN f USING (host, line) WHERE doc_id <> first GROUP BY doc_id),
b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (100 * (n_words - lost_words) < 60 * n_words) AS kept
FROM b
"""
