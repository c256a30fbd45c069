"""The entry point gives whatever is there: queries of absent or broken parts are left out, with a warning if broken."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(sum(not k.startswith('op') for k in q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(REPO / "grovespark", tmp_path / "grovespark", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    return tmp_path


def said(folder):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    graph, text, pipeline = out.stdout.split()
    return int(graph) - (pipeline == "True"), int(text), pipeline, out.stderr


def test_all_that_is_there(copy):
    graph, text, pipeline, _ = said(copy)
    has = (copy / "grovespark/llm").exists()
    assert graph > 70 and (text > 0) == has and (pipeline == "True") == (has and (copy / "corpus_pipeline.py").exists())


def test_without_the_pipeline(copy):
    before = said(copy)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said(copy)[:3] == (*before[:2], "False")


def test_without_the_text_operators(copy):
    before = said(copy)
    shutil.rmtree(copy / "grovespark/llm", ignore_errors=True)
    assert said(copy)[:3] == (before[0], 0, "False")


def test_broken_text_operators_are_named(copy):
    before = said(copy)
    (copy / "grovespark/llm").mkdir(exist_ok=True)
    (copy / "grovespark/llm/queries.py").write_text("import no_such_module\n")
    graph, text, pipeline, warned = said(copy)
    assert (graph, text, pipeline) == (before[0], 0, "False") and "no_such_module" in warned


def test_broken_pipeline_is_named(copy):
    before = said(copy)
    if not before[1]:
        pytest.skip("no text operators")
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    graph, text, pipeline, warned = said(copy)
    assert (graph, text, pipeline) == (*before[:2], "False") and "no_such_module" in warned
