"""Documents as files of their own, written by a Spark data source that commits.

    write_documents(exports, folder)

`exports` has the columns file_name and json. Every document becomes one file under its name. A task writes
into a folder of its attempt and moves the files to their places once it has written them all; the job's
commit removes the attempts and puts the marker _SUCCESS. A job that fails takes its whole folder away, and a
task attempt that fails its own folder: what stands beside the marker is whole. The folder must not exist
before, so there is nothing of others in it. Files are moved by the tasks; the driver gets one count each.

Different documents that share a name would overwrite each other: of such a name, every document gets the
first characters of its text's hash before the extension. Documents repeated as they are make one file. A row
without a name or a text is an error, as is a name that would leave the folder.

With `shards` digits, files go to subfolders by the hash of their name, for stores that list large folders
slowly. The folder is a path or URI that pyarrow's file systems know.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ATTEMPTS, MARKER = "_attempts", "_SUCCESS"
HASH_CHARS = 16


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder given as absolute path or URI."""
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    documents: int


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "file_name string, json string"

    def writer(self, schema: StructType, overwrite: bool) -> "DocumentWriter":
        return DocumentWriter(self.options["path"], int(self.options.get("shards", "0")))


class DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def _target(self, path: str, name: str) -> str:
        if not self.shards:
            return path
        return f"{path}/{hashlib.sha1(name.encode()).hexdigest()[: self.shards]}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, path = place_of(self.folder)
        own = f"{path}/{ATTEMPTS}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        names: set[str] = set()
        try:
            for row in iterator:
                name = row["file_name"]
                if not name or row["json"] is None:
                    raise ValueError("a document has no name or no text")
                if "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"{name!r} cannot be the name of a document")
                with system.open_output_stream(f"{own}/{name}") as out:
                    out.write(row["json"].encode())
                names.add(name)
            for name in sorted(names):
                target = self._target(path, name)
                system.create_dir(target, recursive=True)
                system.move(f"{own}/{name}", f"{target}/{name}")
        finally:
            system.delete_dir(own)
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = place_of(self.folder)
        system.create_dir(path, recursive=True)
        if system.get_file_info(f"{path}/{ATTEMPTS}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{ATTEMPTS}")
        with system.open_output_stream(f"{path}/{MARKER}") as out:
            out.write(b"")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = place_of(self.folder)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


def distinct_names(exports: DataFrame) -> DataFrame:
    """(file_name, json), each document once, names that several documents share told apart by the text's hash.

    Names are counted with partial sums; the counted names that clash are joined back, so a name that many
    documents share is spread by AQE and never one window.
    """
    documents = exports.select("file_name", "json").distinct()
    shared = documents.groupBy("file_name").count().filter("count > 1").select("file_name", F.lit(True).alias("_shared"))
    marked = documents.join(shared, "file_name", "left")
    digest = F.substring(F.sha2("json", 256), 1, HASH_CHARS)
    stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1)
    end = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 2)
    apart = F.concat(stem, F.lit("_"), digest, end)
    return marked.select(F.when(F.col("_shared"), apart).otherwise(F.col("file_name")).alias("file_name"), "json")


def write_documents(exports: DataFrame, folder: str, shards: int = 0) -> None:
    """One file per document; see the module."""
    system, path = place_of(folder)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    exports.sparkSession.dataSource.register(DocumentSink)
    try:
        distinct_names(exports).write.format("document_files").mode("append").option("shards", shards).save(folder)
    except PySparkException:
        # A job that Spark gives up before its tasks end does not always call abort.
        DocumentWriter(folder, shards).abort([])
        raise
