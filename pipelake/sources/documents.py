"""Workflow specs and editor graphs as Spark data sources: ``spark.read.format("workflow_specs")`` and ``"editor_graphs"``.

Reading plans splits by bytes: small files share a task, and a packed file is cut into ranges, each of which takes the documents that begin in it. A document
that cannot be read is a row with parse_error (mode PERMISSIVE) or fails the job (FAILFAST). Files are one YAML or JSON document each, or packed
(suffix ``.packed``): any number of documents, each behind a line ``--- # "id"``, which is YAML too.

Writing takes (id, document) rows and packs all of a task's into one file. Files are staged and moved into place by the commit of the whole
job, so readers see all of them or none; an overwrite removes the older ones then. Paths may be of any file system that Arrow reads.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pipelake.schemas import EDITOR_GRAPH, STEPS

PACKED = ".packed"
MARK = re.compile(rb"^--- # (.*)$", re.M)
SPEC_ROWS = f"path string, {STEPS}, parse_error string"
GRAPH_ROWS = f"path string, graph_id string, {EDITOR_GRAPH}, valid boolean, parse_error string"


def _system(path: str):
    """(file system, path in it); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:", "", path))


@dataclass
class Ranges(InputPartition):
    """(path, begin, end) of the bytes that a task reads; end is None for a whole file."""

    ranges: list[tuple[str, int, int | None]]


def _marks(path: str, file, begin: int, end: int, block: int = 1 << 20) -> Iterator[tuple[str, bytes]]:
    """(id, document) of the documents whose mark begins in [begin, end) of a packed file."""
    file.seek(max(begin - 1, 0))
    held, at, name = b"", max(begin - 1, 0), None
    # A mark begins a line: at the start of the file, or behind a line end, which the byte before the range may be.
    while True:
        data = file.read(block)
        held += data
        marks = [m for m in MARK.finditer(held) if (m.start() or at == 0) and (m.end() < len(held) or not data)]
        done = 0
        for m in marks:
            if name is not None:
                yield name, held[done : m.start()]
            if at + m.start() >= end:
                return
            name, done = (None if at + m.start() < begin else json.loads(m[1])), m.end() + 1
        if name is not None or marks:
            held, at = held[done:], at + done
        elif len(held) > block:
            # No mark yet: keep the tail, in which one may begin.
            cut = held.rfind(b"\n", 0, len(held) - 1)
            if cut > 0:
                held, at = held[cut:], at + cut
            if at >= end:
                return
        if not data:
            if name is not None:
                yield name, held
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict, rows):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64 << 20))
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.rows = rows

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, place = _system(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file]
        hidden = lambda f: any(p[:1] in ("_", ".") for p in f.path[len(place) :].split("/"))
        out, held, size = [], [], 0
        for f in sorted((f for f in files if not hidden(f)), key=lambda f: f.path):
            cuts = range(0, max(f.size, 1), self.split) if f.path.endswith(PACKED) else ()
            for begin in cuts or (0,):
                part = (f.path, begin, min(begin + self.split, f.size) if cuts else None)
                n = (part[2] - begin if cuts else f.size) + 4096  # opening a file costs something too
                if held and size + n > self.split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(part)
                size += n
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path, begin, end in partition.ranges:
            documents: Iterator[tuple[str, bytes]]
            try:
                with system.open_input_file(path) as file:
                    documents = iter([(path, file.read())]) if end is None else _marks(path, file, begin, end)
                    for name, content in documents:
                        yield from self._parsed(path, name, content)
            except OSError as error:
                if self.failfast:
                    raise
                yield from self.rows(path, path, None, error)

    def _parsed(self, path: str, name: str, content: bytes) -> list[tuple]:
        try:
            return list(self.rows(path, name, content, None))
        except Exception as error:
            if self.failfast:
                raise
            return list(self.rows(path, name, None, error))


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, place = _system(self.path)
        task = TaskContext.get()
        staged = f"{place}/_staged-{self.job}/part-{task.partitionId():05d}-{task.taskAttemptId()}{PACKED}"
        out = None
        for name, document, *_ in iterator:
            if out is None:
                system.create_dir(f"{place}/_staged-{self.job}", recursive=True)
                out = system.open_output_stream(staged)
            body = document.strip("\n")
            if "\n--- # " in "\n" + body:
                raise ValueError(f"document {name} holds a mark line")
            out.write(f"--- # {json.dumps(name)}\n{body}\n".encode())
        if out is None:
            return Staged([])
        out.close()
        return Staged([staged])

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, place = _system(self.path)
        system.create_dir(place, recursive=True)
        older = [f.path for f in system.get_file_info(fs.FileSelector(place, recursive=False)) if f.is_file and f.path.endswith(PACKED)] if self.overwrite else []
        for staged in (f for m in messages if m for f in m.files):
            system.move(staged, f"{place}/{self.job}-{staged.rsplit('/', 1)[1]}")
        for path in older:
            system.delete_file(path)
        self._clear(system, place)

    def abort(self, messages: list) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, place: str) -> None:
        from pyarrow import fs

        staged = f"{place}/_staged-{self.job}"
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


def load(content: bytes) -> dict:
    """A JSON or YAML document."""
    if content.lstrip()[:1] == b"{":
        return json.loads(content)
    import yaml

    return yaml.safe_load(content)


def _as_list(value, field: str) -> list[str]:
    """A missing or empty value is no entry, a text is one, a list stays; anything else is an error."""
    if value is None or value == "":
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return value
    raise ValueError(f"{field} has to be a text or a list of texts")


def spec_rows(path: str, name: str, content: bytes | None, error: Exception | None) -> Iterator[tuple]:
    """A row for each step of a spec, or one with the error."""
    if error:
        yield (path, name, *[None] * 11, f"{type(error).__name__}: {error}"[:500])
        return
    spec = load(content)
    if not isinstance(spec, dict) or not isinstance(spec.get("steps"), list):
        raise ValueError("no list of steps")
    shared = spec.get("wildcardFiles") or {}
    for ordinal, step in enumerate(spec["steps"], 1):
        missing = [f for f in ("id", "tool", "command") if not isinstance(step.get(f), str)]
        if missing:
            raise ValueError(f"step {ordinal} lacks {', '.join(missing)}")
        files = {**shared, **(step.get("wildcard_files") or {})} or None
        lists = [_as_list(step.get(f), f) for f in ("input", "output")] + [list(step.get(f) or []) for f in ("previous", "next")]
        yield (path, name, ordinal, step["id"], step["tool"], step["command"], *lists, int(step.get("threads", 1)), step.get("color"), files, None)


NODE = ("label", "tool", "command", "input", "output", "color")


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def graph_rows(path: str, name: str, content: bytes | None, error: Exception | None) -> Iterator[tuple]:
    """One row for a graph file. A graph needs nodes and edges; without one of them it is not valid."""
    if error:
        yield (path, name, None, None, None, None, False, f"{type(error).__name__}: {error}"[:500])
        return
    graph = load(content)
    if not isinstance(graph, dict):
        raise ValueError("not an object")
    nodes, edges = graph.get("nodes"), graph.get("edges")
    valid = isinstance(nodes, list) and isinstance(edges, list)
    nodes = [(_text(n.get("id")), tuple(_text((n.get("data") or {}).get(f)) for f in NODE)) for n in nodes] if isinstance(nodes, list) else None
    edges = [(_text(e.get("source")), _text(e.get("target"))) for e in edges] if isinstance(edges, list) else None
    metadata = {str(k): _text(v) for k, v in (graph.get("metadata") or {}).items()}
    yield (path, name, nodes, edges, graph.get("wildcardFiles"), metadata, valid, None)


class SpecSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workflow_specs"

    def schema(self) -> str:
        return SPEC_ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, spec_rows)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


class GraphSource(SpecSource):
    @classmethod
    def name(cls) -> str:
        return "editor_graphs"

    def schema(self) -> str:
        return GRAPH_ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, graph_rows)


def register(spark: SparkSession) -> None:
    for source in (SpecSource, GraphSource):
        spark.dataSource.register(source)


def read_packed(spark: SparkSession, path: str, kind: str = "workflow_specs", **options) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(**options).load(path)


def write_packed(documents: DataFrame, path: str, kind: str = "workflow_specs", mode: str = "append") -> None:
    """documents(id, document) as packed files, one for each task."""
    register(documents.sparkSession)
    documents.write.format(kind).mode(mode).save(path)
