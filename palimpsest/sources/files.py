"""Small immutable files beside the data: listed, read, and published so that one writer of a name wins."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """A folder of any store that Spark reads. Where it is local a hard link publishes, elsewhere a rename that never replaces."""

    def __init__(self, spark: SparkSession, root: str, link: bool = True):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        place = self._path(root)
        self.fs = place.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(place).toString().rstrip("/")
        self.local = self._path(self.root).toUri().getPath() if link and self.root.startswith("file:") else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        """Sorted names of what a folder holds; none where there is no folder. Names that start with _ or . are not visible."""
        place = self._path(f"{self.root}/{folder}")
        if not self.fs.exists(place):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(place)) if n[0] not in "_.")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def size(self, name: str) -> int:
        place = self._path(f"{self.root}/{name}")
        return self.fs.getContentSummary(place).getLength() if self.fs.exists(place) else 0

    def read(self, name: str) -> dict:
        source = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def read_or_none(self, name: str) -> dict | None:
        """As ``read``; None if the file went since it was listed."""
        try:
            return self.read(name)
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def publish(self, name: str, body: dict) -> bool:
        """Whether this call made ``name``. The file is whole and flushed before its name exists."""
        data = json.dumps(body, sort_keys=True).encode()
        folder, _, last = name.rpartition("/")
        return self._link(folder, last, data) if self.local else self._rename(folder, last, data)

    def _link(self, folder: str, last: str, data: bytes) -> bool:
        home = f"{self.local}/{folder}"
        os.makedirs(home, exist_ok=True)
        part = f"{home}/_{uuid.uuid4().hex}"
        with open(part, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, f"{home}/{last}")
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        with contextlib.closing(_Folder(home)) as opened:
            os.fsync(opened.number)
        return True

    def _rename(self, folder: str, last: str, data: bytes) -> bool:
        home = f"{self.root}/{folder}"
        self.fs.mkdirs(self._path(home))
        part, target = self._path(f"{home}/_{uuid.uuid4().hex}"), self._path(f"{home}/{last}")
        out = self.fs.create(part, False)
        out.write(bytearray(data))
        out.hsync()
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        try:
            context.rename(part, target, self.gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


class _Folder:
    def __init__(self, place: str):
        self.number = os.open(place, os.O_RDONLY)

    def close(self) -> None:
        os.close(self.number)


_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). A temporary one only where none is set and one machine does all the work."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def drop_at_end(spark: SparkSession, folder: str) -> None:
    """Makes a folder that goes when the driver ends, whatever is left in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
