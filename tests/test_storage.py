"""The containment index that stays, and the data sources of graph and forest files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from grovespark.operators import containment, sets
from grovespark.sources import datasource


def words(spark, rows):
    return spark.createDataFrame([(k, sorted(w)) for k, w in rows], "set_id long, word array<int>")


@pytest.fixture(scope="module")
def family():
    rng = random.Random(8)
    return [(k, set(rng.sample(range(1, 40), rng.randint(0, 6)))) for k in range(240)] + [(900, set()), (901, {1000})]


@pytest.fixture(scope="module")
def index(spark, family, tmp_path_factory):
    """Three inserts, and the rows that they reported."""
    out = containment.Index.create(words(spark, family[:100]), str(tmp_path_factory.mktemp("index") / "i"))
    said = [r for k in range(3) for r in out.insert(words(spark, family[k::3])).collect()]
    return out, said


def test_inserts_report_entries(family, index):
    first = {}
    for k in range(3):
        for i, w in sorted(family[k::3]):
            first.setdefault(frozenset(w), i)
    want = {(i, first[frozenset(w)], first[frozenset(w)] == i) for i, w in family}
    assert {tuple(r) for r in index[1]} == want and len(index[1]) == len(family)
    assert {(r["entry"], frozenset(r["word"])) for r in index[0].sets().collect()} == {(i, w) for w, i in first.items()}


def test_three_inserts_equal_one(spark, family, index, tmp_path):
    one = containment.Index.create(words(spark, family[:100]), str(tmp_path / "one"))
    one.insert(words(spark, family)).collect()
    spelled = lambda x: sorted(str(r["word"]) for r in x.sets().collect())
    assert spelled(one) == spelled(index[0])


def test_lookups_equal_brute_force(spark, family, index):
    stored = {r["entry"]: set(r["word"]) for r in index[0].sets().collect()}
    asked = {k: w for k, (_, w) in enumerate(family[::9])} | {1000: {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}, 1001: {5000}, 1002: set()}
    q = words(spark, asked.items()).withColumnRenamed("set_id", "query_id")
    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(index[0].subsets(q)) == {(k, e, len(w) - len(t)) for k, w in asked.items() for e, t in stored.items() if t <= w}
    assert got(index[0].subsets(q, 1)) == {(k, e, len(w) - len(t)) for k, w in asked.items() for e, t in stored.items() if t <= w and len(w) - len(t) <= 1}
    assert got(index[0].supersets(q)) == {(k, e) for k, w in asked.items() for e, t in stored.items() if t >= w}
    assert got(index[0].search(q)) == {(k, next((e for e, t in stored.items() if t == w), None)) for k, w in asked.items()}
    s = index[0].sets().withColumnRenamed("entry", "set_id")
    assert got(index[0].supersets(q)) == got(sets.all_supersets(s, q))


def test_lookups_read_the_partitions_that_they_need(spark, index):
    q = words(spark, [(1, {1000})]).withColumnRenamed("set_id", "query_id")
    empty = next(r["entry"] for r in index[0].sets().collect() if not r["word"])
    assert {r["entry"] for r in index[0].subsets(q).collect()} == {901, empty}
    parts = index[0]._parts(index[0]._keyed(q.withColumnRenamed("query_id", "id")))
    plan = index[0]._read("members", containment.MEMBERS, parts)._jdf.queryExecution().executedPlan().toString()
    assert len(parts) == 1 and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_insert_that_fails_is_not_read(spark, index, monkeypatch):
    before = index[0].sets().count()
    monkeypatch.setattr(containment.Index, "_commit", lambda self, batch: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index[0].insert(words(spark, [(5000, {77, 78, 79})]))
    assert index[0].sets().count() == before


def test_index_of_nothing(spark, tmp_path):
    index = containment.Index.create(words(spark, []), str(tmp_path / "none"))
    assert index.sets().isEmpty() and index.insert(words(spark, [])).isEmpty()
    q = words(spark, [(1, {1}), (2, set())]).withColumnRenamed("set_id", "query_id")
    assert index.subsets(q).isEmpty() and index.supersets(q).isEmpty()


GRAPHS = {"a.b": (3, [(1, 2), (3, 2)]), "empty": (0, []), "alone": (2, []), "loops": (2, [(1, 1), (1, 2), (2, 1)])}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    path = str(tmp_path_factory.mktemp("graphs"))
    rows = spark.createDataFrame([(g, n, [u for u, _ in e], [v for _, v in e], None) for g, (n, e) in GRAPHS.items()], datasource.SCHEMAS["gr"])
    rows.repartition(3).write.format("gr").mode("append").save(path)
    return path


def test_files_of_graphs_round_trip(spark, folder):
    assert sorted(os.listdir(folder)) == sorted(f"{g}.gr" for g in GRAPHS)
    back = spark.read.format("gr").load(folder)
    assert back.rdd.getNumPartitions() == len(GRAPHS)
    assert {r["graph_id"]: (r["n"], list(zip(r["u"], r["v"]))) for r in back.collect()} == GRAPHS
    assert spark.read.format("gr").option("partitions", 2).load(folder).rdd.getNumPartitions() == 2
    vertices, edges = datasource.tables_of(back)
    assert {tuple(r) for r in edges.collect()} == {("a.b", 1, 2), ("a.b", 2, 3), ("loops", 1, 2)} and vertices.count() == 7


@pytest.mark.parametrize(
    "text, fault",
    [
        ("p tdp 3 2\n1 2\n", "1 edges where 2"),
        ("p tdp 3 1\n1 2\n2 3\n", "2 edges where 1"),
        ("p tdp 3 1\n1 4\n", "beyond 1 to 3"),
        ("p tdp 3 1\n0 1\n", "beyond"),
        ("p tdp 3 1\n\n1 2\n", "line 2 is no edge"),
        ("1 2\n", "no line 'p tdp N M'"),
        ("", "no line"),
        ("p cep 3 1\n1 2\n", "no line"),
        ("c note\r\np tdp 3 1\r\nc more\r\n1 2\r\n", None),
    ],
)
def test_malformed_graph_files(spark, tmp_path, text, fault):
    datasource.register(spark)
    (tmp_path / "x.gr").write_text(text)
    (row,) = spark.read.format("gr").load(str(tmp_path)).collect()
    assert row["graph_id"] == "x" and (row["fault"] is None if fault is None else fault in row["fault"] and row["u"] is None)
    if fault:
        with pytest.raises(Exception, match="x.gr"):
            spark.read.format("gr").option("mode", "STRICT").load(str(tmp_path)).collect()


def test_files_of_forests(spark, tmp_path):
    datasource.register(spark)
    rows = spark.createDataFrame([("t", 2, [0, 1, 1], None), ("none", 0, [], None)], datasource.SCHEMAS["tree"])
    rows.write.format("tree").mode("append").save(str(tmp_path))
    (tmp_path / "bad.tree").write_text("2\n0\nx\n")
    (tmp_path / "far.tree").write_text("2\n0\n7\n")
    back = {r["graph_id"]: (r["depth"], r["parent"], r["fault"] is None) for r in spark.read.format("tree").load(str(tmp_path)).collect()}
    assert back == {"t": (2, [0, 1, 1], True), "none": (0, [], True), "bad": (None, None, False), "far": (None, None, False)}


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    datasource.register(spark)
    rows = spark.createDataFrame([(f"g{k}", 1, [], [], None) for k in range(6)] + [("a/b", 1, [], [], None)], datasource.SCHEMAS["gr"]).repartition(4)
    with pytest.raises(Exception, match="no file name"):
        rows.write.format("gr").mode("append").save(str(tmp_path))
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]
    with pytest.raises(Exception, match="append"):
        rows.where(F.col("graph_id") != "a/b").write.format("gr").mode("overwrite").save(str(tmp_path))


@pytest.mark.parametrize("kind", ["gr", "tree"])
def test_the_driver_lists_no_files_of_folders(spark, tmp_path, monkeypatch, kind):
    """Messages and partitions name folders, whatever the number of files; a name written again is replaced."""
    monkeypatch.setattr(datasource, "PART_FILES", 7)
    row = (lambda k: (f"g{k}", 1, [], [], None)) if kind == "gr" else (lambda k: (f"g{k}", 1, [0], None))
    cls = datasource.GraphFiles if kind == "gr" else datasource.TreeFiles
    rows = [spark.createDataFrame([row(k) for k in range(n)], datasource.SCHEMAS[kind]).collect() for n in (60, 20)]
    for some in rows:
        writer = datasource._Writer(kind, {"path": str(tmp_path), "folders": "8"}, False)
        message = writer.write(iter(some))
        assert "g1." not in str(message) and message.parts == -(-len(some) // 7)
        writer.commit([message, None])
    reader = datasource._Reader(kind, {"path": str(tmp_path), "partitions": "3"})
    parts = reader.partitions()
    assert len(parts) == 3 and not any(p.paths for p in parts) and sum(len(p.folders) for p in parts) == 8
    assert sorted(x[0] for p in parts for x in reader.read(p)) == sorted(f"g{k}" for k in range(60))
    spark.dataSource.register(cls)
    assert spark.read.format(kind).load(str(tmp_path)).where("fault IS NULL").count() == 60
    assert not any(x.startswith("_") for x in os.listdir(tmp_path))
