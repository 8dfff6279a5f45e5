"""A sink that writes a file of its own for each row, with a commit step."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscope.shared import filesystem, let_go

SUFFIX = ".md"
#: Files that the commit renames at once.
RENAMES = 16


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and how many files it holds; their names stay in the folder."""

    folder: str
    files: int


class MarkdownSink(DataSource):
    """Rows (slug, text) as files <path>/<slug>.md."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "slug string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MarkdownWriter(self.options["path"], overwrite)


class MarkdownWriter(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own below <path>/.writing-<job>; the commit renames the files of the attempts that count, and removes the rest. Texts are written from the batch that they came in, with no copies as strings."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{filesystem(self.path)[1].rstrip('/')}/.writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = filesystem(self.path)
        context = TaskContext.get()
        own, n = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}", 0
        for batch in iterator:
            for slug, text in zip(batch.column("slug").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                if not slug or "/" in slug or slug.startswith("."):
                    raise ValueError(f"not a file's name: {slug!r}")
                if not n:
                    fs.create_dir(own, recursive=True)
                with fs.open_output_stream(f"{own}/{slug}{SUFFIX}") as out:
                    out.write(text.as_buffer() or b"")
                n += 1
            let_go()
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        root = root.rstrip("/")
        fs.create_dir(root, recursive=True)
        old = {x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(SUFFIX)} if self.overwrite else set()
        with ThreadPoolExecutor(RENAMES) as pool:
            for m in messages:
                if m is not None and m.files:
                    made = [x.base_name for x in fs.get_file_info(pafs.FileSelector(m.folder))]
                    list(pool.map(lambda name, own=m.folder: fs.move(f"{own}/{name}", f"{root}/{name}"), made))
                    old.difference_update(made)
            list(pool.map(lambda name: fs.delete_file(f"{root}/{name}"), old))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)
