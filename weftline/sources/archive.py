"""An archive's files as a data source: robots files, sitemaps, run documents, manifests and plain files, read in partitions
of files, and files written so that a task that is tried again leaves nothing of its first try.

    spark.read.format("weft_archive").option("kind", "run").load(folder)
    rows.write.format("weft_archive").mode("append").save(folder)
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from weftline.functions.feeds import FIELDS, directives, entries

NAME = "weft_archive"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes that opening a file counts as, so that many small files are dealt out too; bytes of small files' rows sent together; moves at a time at the end of a write, each of a lot of files.
OPENING, TOGETHER, MOVES, LOT = 1 << 18, 1 << 20, 16, 64
#: Of each kind: the files that are taken, and the columns after `file`, the path below the root.
KINDS = {
    "file": (("*",), "content binary, size long"),
    "robots": (("*robots.txt",), "n int, kind string, value string"),
    "sitemap": (("*.xml", "*.rss", "*.xml.gz"), ", ".join(f"{name} string" for name in FIELDS)),
    "run": (("*experiment_*.json",), "timestamp string, total_experiments long, successful long, failed long"),
    "result": (("*experiment_*.json",), "n int, result string"),
    "capture": (("*metadata.json",), "n int, entry string"),
    "manifest": (("*download_manifest.json",), "timestamp string, url string, success long, failed long, skipped long"),
    "download": (("*download_manifest.json",), "ok boolean, url string, local_path string, method string, size long, reason string"),
}


def _text(content: bytes) -> str:
    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8")


def _document(content: bytes) -> dict:
    found = json.loads(_text(content))
    if not isinstance(found, dict):
        raise ValueError("the document is no object")
    return found


def _run(content: bytes) -> list[tuple]:
    told = _document(content).get("metadata", {})
    return [(told.get("timestamp", "unknown"), *(told.get(name, 0) for name in ("total_experiments", "successful", "failed")))]


def _captures(content: bytes) -> list[tuple]:
    told = json.loads(_text(content))
    if not isinstance(told, list):
        raise ValueError("the document is no list")
    return [(n, json.dumps(x, ensure_ascii=False)) for n, x in enumerate(told)]


def _manifest(content: bytes) -> list[tuple]:
    told = _document(content)
    return [(told.get("timestamp"), told.get("url"), *(told.get("statistics", {}).get(name, 0) for name in ("success", "failed", "skipped")))]


def _downloads(content: bytes) -> list[tuple]:
    told = _document(content)
    good = [(True, x.get("url"), x.get("local_path"), x.get("method"), x.get("size"), None) for x in told.get("successful_downloads", [])]
    return good + [(False, x.get("url"), None, None, None, x.get("reason")) for x in told.get("failed_downloads", [])]


_ROWS = {
    "file": lambda content: [(content, len(content))],
    "robots": lambda content: [(n, *x) for n, x in enumerate(directives(_text(content)))],
    "sitemap": lambda content: entries(_text(content)),
    "run": _run,
    "result": lambda content: [(n, json.dumps(x, ensure_ascii=False)) for n, x in enumerate(_document(content).get("results", []))],
    "capture": _captures,
    "manifest": _manifest,
    "download": _downloads,
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def opened(root: str):
    """The file system of a URI or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


@dataclass
class Files(InputPartition):
    """Files of about `bytes` together, by their paths below the root."""

    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, root: str, kind: str, pattern: tuple[str, ...], most: int, strict: bool):
        self.root, self.kind, self.pattern, self.most, self.strict = root, kind, pattern, most, strict
        self.wanted: list[Filter] = []

    def _takes(self, name: str) -> bool:
        def holds(f: Filter) -> bool:
            return name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) if isinstance(f, StringStartsWith) else name.endswith(f.value)

        hidden = any(part[:1] in "._" for part in name.split("/"))
        return not hidden and any(fnmatch.fnmatchcase(name, p) for p in self.pattern) and all(holds(f) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        """Names and sizes are listed here; no file is opened. Filters on the file leave files out before they are read."""
        from pyarrow import fs

        files, base = opened(self.root)
        out, own, size = [], [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda x: x.path):
            name = info.path[len(base.rstrip("/")) + 1 :]
            if info.is_file and self._takes(name):
                if own and size + info.size + OPENING > self.most:
                    out.append(Files(own))
                    own, size = [], 0
                own.append(name)
                size += info.size + OPENING
        return [*out, Files(own)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, base = opened(self.root)
        columns = ["file", *(c.split()[0] for c in KINDS[self.kind][1].split(", "))]
        kinds = [pa.string(), *(_ARROW[c.split()[1]] for c in KINDS[self.kind][1].split(", "))]
        held, size = [], 0
        for name in partition.names:
            with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                content = stream.read()
            try:
                rows = _ROWS[self.kind](content)
                arrays = [pa.array(x, k) for x, k in zip(zip(*((name, *r) for r in rows), strict=True), kinds, strict=True)]
            except (ValueError, OSError, EOFError, AttributeError, TypeError, pa.ArrowException) as broken:
                if self.strict:
                    raise ValueError(f"{name} is no {self.kind}: {broken}") from broken
                continue
            if rows:
                held.append(pa.RecordBatch.from_arrays(arrays, columns))
                size += held[-1].nbytes
            if size >= TOGETHER or len(held) >= 1000:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)


class PushingReader(Reader):
    """Takes filters on the file's path, where the session lets Python sources have filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("file",):
                self.wanted.append(f)
            else:
                yield f


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class Writer(DataSourceArrowWriter):
    """Rows (path, content) become files below root.

    A task writes into a folder of its own try; nothing is at its place before all tasks are done. Then the files of the
    tries that counted are moved, folders that are new as a whole, those of one try after those of another, and the rest is removed: a try that failed, or ran beside another,
    leaves nothing. A path that occurs twice in a task, with other content, is an error; an equal file that is there already
    stays untouched with `changed`. Paths ending in .gz are compressed, with the same bytes each time.
    """

    def __init__(self, root: str, changed: bool):
        self.root, self.changed = root, changed
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        files, base = opened(self.root)
        task = TaskContext.get()
        folder = f"{base}/{self.staging}/{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        made, n = set(), 0
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path is None or content is None:
                    continue
                parts = [x for x in path.replace("\\", "/").split("/") if x not in ("", ".")]
                if not parts or ".." in parts or parts[0].startswith("_staging-"):
                    raise ValueError(f"no path below the root: {path}")
                data = content.encode() if isinstance(content, str) else content
                data = gzip.compress(data, mtime=0) if parts[-1].endswith(".gz") else data
                to = "/".join([folder, *parts])
                if _content(files, to) is not None:
                    if _content(files, to) != data:
                        raise ValueError(f"two contents for {path}")
                    continue
                if self.changed and _content(files, "/".join([base, *parts])) == data:
                    continue
                if (above := to.rpartition("/")[0]) not in made:
                    files.create_dir(above, recursive=True)
                    made.add(above)
                with files.open_output_stream(to, compression=None) as out:
                    out.write(data)
                n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        from pyarrow import fs

        files, base = opened(self.root)
        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message and message.files:
                    there = files.get_file_info(fs.FileSelector(message.folder))
                    while there:
                        lots = [there[i : i + LOT] for i in range(0, len(there), LOT)]
                        there = [below for own in pool.map(lambda lot: _merged(files, lot, message.folder, base), lots) for below in own]
        self._clear(files, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.root))

    def _clear(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self.staging}")


def _merged(files, found: list, root: str, base: str) -> list:
    """Moves files and folders found below root to their places below base, and returns what is in the folders that are there already; those are not moved."""
    from pyarrow import fs

    below = []
    for info in found:
        to = base + info.path[len(root) :]
        # Stores without folders move files alone.
        if info.is_file or files.type_name == "local":
            try:
                files.move(info.path, to)
                continue
            except OSError:
                if info.is_file or files.get_file_info(to).type != fs.FileType.Directory:
                    raise
        else:
            files.create_dir(to, recursive=True)
        below += files.get_file_info(fs.FileSelector(info.path))
    return below


def _content(files, path: str) -> bytes | None:
    from pyarrow import fs

    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path, compression=None) as stream:
        return stream.read()


class ArchiveSource(DataSource):
    """Options: path, kind (of KINDS), pattern (instead of the kind's own, by commas), bytes (of files in a partition), mode (`skip` broken files, or `fail`), pushdown, changed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "file")
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind}")
        return kind

    def schema(self) -> str:
        return f"file string, {KINDS[self.kind][1]}"

    def reader(self, schema) -> DataSourceReader:
        pattern = tuple(x.strip() for x in self.options["pattern"].split(",")) if "pattern" in self.options else KINDS[self.kind][0]
        form = PushingReader if self.options.get("pushdown") == "true" else Reader
        return form(self.options["path"], self.kind, pattern, int(self.options.get("bytes", 64 << 20)), self.options.get("mode", "skip") == "fail")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are added to an archive: use append")
        return Writer(self.options["path"], self.options.get("changed") == "true")


def read(spark: SparkSession, folder: str, kind: str, **options: str) -> DataFrame:
    """The rows of an archive's files of a kind; filters on `file` reach the listing where the session allows it."""
    spark.dataSource.register(ArchiveSource)
    pushdown = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format(NAME).options(kind=kind, pushdown=pushdown, **options).load(folder)


def write(rows: DataFrame, folder: str, **options: str) -> None:
    """Writes rows (path, content) as files below folder, a place that all workers share; rows without either are left out. Equal paths meet in one task, so that contradictions are seen."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    given = rows.select("path", rows["content"].cast("binary").alias("content")).where("path is not null and content is not null")
    given.repartition("path").write.format(NAME).options(**options).mode("append").save(folder)
