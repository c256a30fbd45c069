"""Data sources 'gr' and 'tree': a row for each file of graphs or forests, and a writer whose files appear when its job commits.

    register(spark)
    graphs = spark.read.format("gr").load("graphs")              # graph_id, n, u[], v[], fault
    graphs.write.format("gr").mode("append").save("elsewhere")   # a file <graph_id>.gr a row

Paths are local ones or those of a filesystem that pyarrow knows (hdfs, s3, gs); each of the reader's
partitions has some of the files, one each unless option partitions says otherwise. Of very many files
the driver should list none: with the writer's option folders=N a file's place is in one of N folders
that its name alone decides, and a reader with fewer partitions than there are folders deals these to
tasks, which list them. Commit messages have folders alone; files are moved some PART_FILES at a time. A file that breaks
the format has its fault named in the row and nothing else; with option mode STRICT it is an error.

Spark keeps a Python process beside the driver for each step of planning, and each loads this module:
what only tasks and the commit need is imported there.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

if TYPE_CHECKING:
    import pyarrow.fs as fs
    from pyspark.sql import DataFrame, Row, SparkSession

SCHEMAS = {"gr": "graph_id string, n int, u array<int>, v array<int>, fault string", "tree": "graph_id string, depth int, parent array<int>, fault string"}
_HEAD = re.compile(r"p\s+tdp\s+(\d+)\s+(\d+)\s*")
_EDGE = re.compile(r"\s*(\d+)\s+(\d+)\s*")
_COMMENT = re.compile(r"c(\s|$)")
#: Files that a task writes into one folder, and that the driver lists and moves at a time.
PART_FILES = 1000


class Malformed(ValueError):
    pass


def parse_gr(text: str) -> tuple[int, list[int], list[int]]:
    """(n, u, v) of a graph's text: a line 'p tdp N M', then M lines of an edge each, ends from 1 to N; lines of 'c' are comments.

    Edges are as they stand: loops, repeats and turned ends are the caller's to judge.
    """
    lines = [x for x in text.replace("\r", "").removesuffix("\n").split("\n") if not _COMMENT.match(x)]
    if not (head := _HEAD.fullmatch(lines[0])):
        raise Malformed("no line 'p tdp N M' at the start")
    n, m = map(int, head.groups())
    us, vs = [], []
    for k, line in enumerate(lines[1:], 2):
        if not (edge := _EDGE.fullmatch(line)):
            raise Malformed(f"line {k} is no edge")
        u, v = map(int, edge.groups())
        if not (1 <= u <= n and 1 <= v <= n):
            raise Malformed(f"line {k} has an end beyond 1 to {n}")
        us.append(u)
        vs.append(v)
    if len(us) != m:
        raise Malformed(f"{len(us)} edges where {m} are declared")
    return n, us, vs


def parse_tree(text: str) -> tuple[int, list[int]]:
    """(depth, parents) of a forest's text: its depth, then the parent of each vertex, 0 for a root."""
    try:
        depth, *parents = map(int, text.split())
    except ValueError:
        raise Malformed("no whole numbers") from None
    if any(not 0 <= p <= len(parents) for p in parents):
        raise Malformed(f"a parent beyond 0 to {len(parents)}")
    return depth, parents


def spell_gr(n: int, us: list[int], vs: list[int]) -> str:
    return "".join([f"p tdp {n} {len(us)}\n", *(f"{u} {v}\n" for u, v in zip(us, vs))])


def spell_tree(depth: int, parents: list[int]) -> str:
    return "".join(f"{x}\n" for x in (depth, *parents))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]
    #: folders whose files the task finds by itself
    folders: list[str]


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.path = kind, options["path"]
        self.strict, self.most = options.get("mode", "PERMISSIVE").upper() == "STRICT", int(options.get("partitions", "0"))

    def partitions(self) -> list[Files]:
        import pyarrow.fs as fs

        place, path = _place(self.path)
        if place.get_file_info(path).is_file:
            return [Files([path], [])]
        if self.most:
            top = place.get_file_info(fs.FileSelector(path))
            folders = sorted(x.path for x in top if x.type == fs.FileType.Directory and "/_" not in x.path[len(path) :])
            if len(folders) >= self.most:
                paths = sorted(x.path for x in top if self._is_one(x, path))
                return [Files(paths[k :: self.most], folders[k :: self.most]) for k in range(self.most)]
        paths = self._below(place, path)
        parts = min(len(paths), self.most or len(paths))
        return [Files(paths[k::parts], []) for k in range(parts)]

    def _is_one(self, x: fs.FileInfo, root: str) -> bool:
        return x.is_file and x.path.endswith(f".{self.kind}") and "/_" not in x.path[len(root) :]

    def _below(self, place: fs.FileSystem, folder: str) -> list[str]:
        import pyarrow.fs as fs

        return sorted(x.path for x in place.get_file_info(fs.FileSelector(folder, recursive=True)) if self._is_one(x, folder))

    def read(self, partition: Files) -> Iterator[tuple]:
        place = _place(self.path)[0]
        for path in (*partition.paths, *(p for folder in partition.folders for p in self._below(place, folder))):
            name = path.rsplit("/", 1)[-1].removesuffix(f".{self.kind}")
            with place.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            try:
                yield (name, *(parse_gr(text) if self.kind == "gr" else parse_tree(text)), None)
            except Malformed as e:
                if self.strict:
                    raise Malformed(f"{path}: {e}") from None
                yield (name, *[None] * (3 if self.kind == "gr" else 2), str(e))


@dataclass
class Written(WriterCommitMessage):
    #: a task's folder, and how many folders of files are in it, named from 0 on
    folder: str
    parts: int


class _Writer(DataSourceWriter):
    """Tasks write under a folder of the job; commit moves their files to their places, abort removes the folder."""

    def __init__(self, kind: str, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        self.kind, self.path, self.folders = kind, options["path"].rstrip("/"), int(options.get("folders", "0"))
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        place, path = _place(self.path)
        folder, parts = f"{path}/{self.job}/{uuid.uuid4().hex}", 0  # a task that is run again has another
        place.create_dir(folder, recursive=True)
        for k, row in enumerate(rows):
            if k % PART_FILES == 0:
                place.create_dir(f"{folder}/{parts}")
                parts += 1
            text = spell_gr(row["n"], row["u"] or [], row["v"] or []) if self.kind == "gr" else spell_tree(row["depth"], row["parent"] or [])
            name = f"{row['graph_id']}.{self.kind}"
            if "/" in name or name.startswith("_"):
                raise ValueError(f"{name!r} is no file name")
            with place.open_output_stream(f"{folder}/{parts - 1}/{name}") as f:
                f.write(text.encode())
        return Written(folder, parts)

    def commit(self, messages: list[Written | None]) -> None:
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow.fs as fs

        place, path = _place(self.path)
        made = {path}

        def moved(found: str) -> None:
            name = found.rsplit("/", 1)[-1]
            place.move(found, f"{self._home(path, name)}/{name}")

        with ThreadPoolExecutor(8) as pool:
            for message in messages:
                for part in range(message.parts if message else 0):
                    found = [x.path for x in place.get_file_info(fs.FileSelector(f"{message.folder}/{part}"))]
                    for home in {self._home(path, x.rsplit("/", 1)[-1]) for x in found} - made:
                        place.create_dir(home)
                        made.add(home)
                    for _ in pool.map(moved, found):
                        pass
        if place.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            place.delete_dir(f"{path}/{self.job}")

    def _home(self, path: str, name: str) -> str:
        return f"{path}/{zlib.crc32(name.encode()) % self.folders}" if self.folders else path

    def abort(self, messages: list[Written | None]) -> None:
        import pyarrow.fs as fs

        place, path = _place(self.path)
        if place.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            place.delete_dir(f"{path}/{self.job}")


class GraphFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gr"

    def schema(self) -> str:
        return SCHEMAS[self.name()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.name(), dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.name(), dict(self.options), overwrite)


class TreeFiles(GraphFiles):
    @classmethod
    def name(cls) -> str:
        return "tree"


def register(spark: SparkSession) -> None:
    for source in (GraphFiles, TreeFiles):
        spark.dataSource.register(source)


def rows_of(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n, u, v), a row a graph, as the writer takes them; vertices must be 1 to n."""
    from pyspark.sql import functions as F

    n = vertices.groupBy("graph_id").agg(F.max("v").alias("n"))
    pairs = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("e"))
    return n.join(pairs, "graph_id", "left").select("graph_id", "n", F.col("e.u").alias("u"), F.col("e.v").alias("v"), F.lit(None).cast("string").alias("fault"))


def tables_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of rows without a fault: loops and repeats dropped."""
    from pyspark.sql import functions as F

    from grovespark.operators.graph import canonical_edges

    good = rows.where("fault IS NULL")
    pairs = good.select("graph_id", F.explode(F.arrays_zip("u", "v")).alias("e")).select("graph_id", "e.u", "e.v")
    return good.where("n > 0").select("graph_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("v")), canonical_edges(pairs)
