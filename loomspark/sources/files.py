"""Small files on any Hadoop file system: what the store needs beside Spark's own readers and writers."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
from functools import lru_cache
from typing import Any

from pyspark.sql import SparkSession


@lru_cache(1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loomspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may leave it unset, and gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def modified(self, name: str) -> float:
        """When the file was last written or touched, in seconds."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def touch(self, name: str) -> None:
        self._fs.setTimes(self._path(name), int(time.time() * 1000), -1)

    def create(self, name: str, text: str, sync: bool = False) -> bool:
        """Writes a new file; false if there is one already. sync waits until it is on disk, where the file system can tell."""
        if self.exists(name):
            return False
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:  # another writer was faster
            if "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        if sync:
            out.hsync()
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def create_record(self, name: str, value: Any, sync: bool = False) -> bool:
        """A JSON value behind its checksum, so that a torn file is known as such."""
        body = json.dumps(value, sort_keys=True, separators=(",", ":"))
        return self.create(name, f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}", sync)

    def read_record(self, name: str) -> Any | None:
        """The value, or None if the file is torn or damaged."""
        try:
            digest, _, body = self.read(name).partition("\n")
            return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == digest else None
        except (ValueError, OSError) as _:
            return None
        except Exception as e:
            if "ChecksumException" in str(e):
                return None
            raise
