"""Treedepths published for a public corpus of graphs; $BENCH_GRAPHS is the folder of its files exact_<number>.gr."""

import os

import pytest

from grovespark.functions.loops import written
from grovespark.operators import fixpoint, forms, kernels, verify
from grovespark.sources import datasource

FOLDER = os.environ.get("BENCH_GRAPHS")
pytestmark = pytest.mark.skipif(not FOLDER, reason="BENCH_GRAPHS is not set")

#: Number of the graph and its treedepth.
PUBLISHED = {
    f"exact_{k}": int(td)
    for k, td in (x.split() for x in """
001 6, 003 11, 005 5, 007 9, 009 6, 011 5, 013 7, 015 5, 017 10, 019 7, 021 5, 023 7, 025 8, 027 11, 029 12,
031 11, 033 12, 035 9, 037 7, 039 7, 041 5, 043 14, 045 11, 047 25, 049 10, 051 11, 053 7, 055 9, 057 13, 059 42,
061 13, 063 12, 065 11, 067 9, 069 6, 071 15, 073 16, 077 12, 079 9, 081 7, 083 22, 085 13, 087 13, 089 15, 091 9,
093 6, 095 8, 097 7, 099 13, 103 13, 105 9, 107 11, 109 9, 111 18, 113 6, 115 12, 123 12, 125 10, 127 8, 133 15,
137 58, 141 13, 143 16, 145 7, 151 7, 153 14, 157 11, 159 15, 161 13, 165 9, 173 16, 177 9, 181 10, 185 19, 189 8
""".replace("\n", " ").split(", "))
}


@pytest.fixture(scope="module")
def corpus(spark):
    datasource.register(spark)
    rows = written(spark.read.format("gr").option("mode", "STRICT").option("partitions", 16).load(FOLDER))
    return datasource.tables_of(rows.where(rows["graph_id"].isin(list(PUBLISHED))))


def test_no_bound_contradicts_a_published_depth(corpus):
    solved = written(kernels.solve(*corpus, seconds=float(os.environ.get("BENCH_GRAPH_SECONDS", "5"))))
    rows = solved.collect()
    assert len(rows) == len(PUBLISHED) and all(r["lb"] <= PUBLISHED[r["graph_id"]] <= r["ub"] for r in rows)
    assert sum(r["status"] == "exact" for r in rows) >= 45
    assert verify.verify(*corpus, kernels.trees(solved), solved.selectExpr("graph_id", "ub AS depth")).where("NOT ok").isEmpty()


def test_forms_and_fixpoint_of_small_graphs(corpus):
    small = [f"exact_{k:03}" for k in (1, 3, 5, 7, 9, 11, 13, 15)]
    vertices, edges = (x.where(x["graph_id"].isin(small)) for x in corpus)
    want = {g: PUBLISHED[g] for g in small}
    assert {r["graph_id"]: r["td"] for r in forms.solve(vertices, edges).collect()} == want
    assert {r["graph_id"]: r["td"] for r in fixpoint.solve(vertices, edges).treedepth().collect()} == want
