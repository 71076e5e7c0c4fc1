"""Small files in folders that the driver and executors see: commit logs, and scratch space."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one in the warehouse where that is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


class Folder:
    """A folder in any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, name: str = "") -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> dict[str, tuple[int, int]]:
        """{name: (bytes, last change in epoch milliseconds)} of what lies in the folder; nothing if there is none."""
        if not self._fs.exists(self._at(name)):
            return {}
        return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self._at(name)) if not s.getPath().getName().startswith((".", "_"))}

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def delete_on_exit(self) -> None:
        self._fs.mkdirs(self._at())
        self._fs.deleteOnExit(self._at())

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; False if there is one of that name, which then stays as it is."""
        if self._fs.exists(self._at(name)):
            return False
        folder, _, last = name.rpartition("/")
        draft = self._at(f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/"))
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        try:
            context.rename(draft, self._at(name), self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(self._at(name)):
                return False
            raise
        return True


class CommitLog:
    """Numbered entries, each written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit())

    def times(self) -> dict[int, int]:
        return {int(n): at for n, (_, at) in self.folder.names().items() if n.isdigit()}

    def get(self, number: int) -> Any:
        return json.loads(self.folder.read(f"{number:012d}"))

    def put(self, number: int, entry: Any) -> bool:
        return self.folder.put(f"{number:012d}", json.dumps(entry))

    def once(self, number: int, entry: Any) -> Any:
        """The entry of that number: this one, if there was none."""
        return entry if self.put(number, entry) else self.get(number)

    def delete(self, number: int) -> None:
        self.folder.delete(f"{number:012d}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    Folder(spark, path).delete_on_exit()
    return path
