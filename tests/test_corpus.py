"""Batch runs over files of paths and random graphs."""

import random

from grovespark.operators import graph, kernels
from grovespark.plans import corpus


def test_folder_run(spark, tmp_path):
    rng = random.Random(2)
    golden = []
    for k, n in enumerate((7, 12, 15, 31)):
        (tmp_path / f"path_{n}.gr").write_text(f"p tdp {n} {n - 1}\n" + "".join(f"{i} {i + 1}\n" for i in range(1, n)))
        golden.append((f"path_{n}", n.bit_length()))
    for k in range(6):
        edges = sorted({(rng.randrange(1, v), v) for v in range(2, 15)} | {tuple(sorted(rng.sample(range(1, 15), 2))) for _ in range(8)})
        (tmp_path / f"random_{k}.gr").write_text(f"p tdp 14 {len(edges)}\n" + "".join(f"{u} {v}\n" for u, v in edges))
    report, trees = corpus.solve_folder(spark, str(tmp_path))
    rows = report.collect()
    assert len(rows) == 10 and all(r["ok"] and r["status"] == "exact" for r in rows)
    assert corpus.disagreements(report, spark.createDataFrame(golden, "graph_id string, td int")).isEmpty()
    assert corpus.disagreements(report, spark.createDataFrame([("path_7", 9)], "graph_id string, td int")).count() == 1
    from grovespark.sources import files

    vertices, edges = files.read_gr(spark, str(tmp_path))
    assert {r["graph_id"]: r["td"] for r in kernels.brute_force(vertices, edges).where("graph_id LIKE 'random%'").collect()} == {r["graph_id"]: r["td"] for r in rows if r["graph_id"].startswith("random")}
    assert trees.count() == vertices.count()


def test_time_limit_leaves_verified_bounds(spark):
    rng = random.Random(5)
    pairs = [("g", u, v) for u in range(1, 40) for v in range(u + 1, 41) if rng.random() < 0.2]
    edges = spark.createDataFrame(pairs, "graph_id string, u int, v int")
    row = kernels.solve(graph.vertices_of(edges), edges, 0.01).first()
    assert row["status"] in ("exact", "bounded") and row["lb"] <= row["ub"] and (row["td"] is None) == (row["lb"] < row["ub"])
