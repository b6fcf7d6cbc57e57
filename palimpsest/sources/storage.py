"""Files of a table, through Hadoop's file systems: local, HDFS and object stores alike."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from palimpsest.errors import TableError


@dataclass(frozen=True)
class Credentials:
    access_key: str
    secret_key: str
    session_token: str | None = None

    @classmethod
    def from_env(cls) -> Credentials:
        return cls(os.environ["AWS_ACCESS_KEY_ID"], os.environ["AWS_SECRET_ACCESS_KEY"], os.environ.get("AWS_SESSION_TOKEN"))


@dataclass(frozen=True)
class ObjectStore:
    """A prefix of a bucket in an S3-compatible store."""

    bucket: str
    prefix: str = ""
    credentials: Credentials | None = None
    endpoint: str | None = None
    region: str | None = None
    kms_key: str | None = None
    path_style: bool = False
    checksum: str | None = None
    versioned: bool = False

    @property
    def root(self) -> str:
        return f"s3a://{self.bucket}/{self.prefix.strip('/')}".rstrip("/")

    def settings(self) -> dict[str, str]:
        p = f"fs.s3a.bucket.{self.bucket}."
        out = {}
        if self.credentials:
            out |= {p + "access.key": self.credentials.access_key, p + "secret.key": self.credentials.secret_key}
            if self.credentials.session_token:
                out |= {p + "session.token": self.credentials.session_token, p + "aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"}
        if self.endpoint:
            out[p + "endpoint"] = self.endpoint
        if self.region:
            out[p + "endpoint.region"] = self.region
        if self.kms_key:
            out |= {p + "encryption.algorithm": "SSE-KMS", p + "encryption.key": self.kms_key}
        if self.path_style:
            out[p + "path.style.access"] = "true"
        if self.checksum:
            out[p + "create.checksum.algorithm"] = self.checksum
        if self.versioned:
            out |= {p + "change.detection.source": "versionid", p + "change.detection.mode": "server"}
        return out

    def configure(self, spark: SparkSession) -> str:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in self.settings().items():
            conf.set(k, v)
        return self.root


@dataclass(frozen=True)
class HadoopStore:
    """Any other file system: its URI, and the Hadoop settings that it needs, such as ``fs.<scheme>.impl``."""

    root: str
    settings: tuple[tuple[str, str], ...] = ()

    def configure(self, spark: SparkSession) -> str:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in self.settings:
            conf.set(k, v)
        return self.root


def scratch(spark: SparkSession, label: str = "scratch") -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else the warehouse.

    On a cluster a warehouse on the machine's own disk is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None) and base.startswith(("file:", "/")):
        raise TableError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Storage:
    """Small files below one root; data files are Spark's own business."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def sizes(self, folder: str, suffix: str) -> dict[str, int]:
        return {f"{folder}/{s.getPath().getName()}": s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(suffix)}

    def read(self, name: str) -> str:
        path = self._path(name)
        try:
            stream = self._fs.open(path)
        except Py4JJavaError as e:
            raise FileNotFoundError(name) if not self._fs.exists(path) else e
        try:
            return bytes(stream.readNBytes(self._fs.getFileStatus(path).getLen())).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publish a new file, complete or not at all; False if there is one of that name already.

        The text is written under another name first. A local file is then linked to its name, and one
        of HDFS renamed, which both fail if the name is taken. Object stores show an object only once it
        is complete; there the store is asked to refuse a second one (a conditional put).
        """
        path, scheme = self._path(name), self._fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._put(path, text)
        self._fs.mkdirs(path.getParent())
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        self._fill(self._fs.create(draft, False), text)
        try:
            if scheme == "file":
                files, local = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    files.createLink(local(path), local(draft))
                except Py4JJavaError:
                    if self._fs.exists(path):
                        return False
                    raise
                return True
            return bool(self._fs.rename(draft, path))
        finally:
            self._fs.delete(draft, False)

    def _put(self, path, text: str) -> bool:
        try:
            self._fill(self._fs.createFile(path).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", "true").build(), text)
        except Py4JJavaError:
            if self._fs.exists(path):
                return False
            raise
        return True

    @staticmethod
    def _fill(stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def footer(self, name: str, columns: dict[str, T.DataType | None]) -> tuple[int, dict[str, tuple]]:
        """Rows of a Parquet file and, for each column, (least, greatest, nulls); None where the footer does not tell.

        Bounds are read for whole numbers, doubles, booleans and strings; for a column of type None, nulls only.
        """
        hadoop = self._jvm.org.apache.parquet.hadoop
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(self._path(name), self.spark.sparkContext._jsc.hadoopConfiguration()))
        rows, seen = 0, {c: [[], [], 0] for c in columns}
        try:
            for block in reader.getFooter().getBlocks():
                rows += block.getRowCount()
                for chunk in block.getColumns():
                    path = chunk.getPath()
                    if path.size() > 1 or (at := path.toArray()[0]) not in columns:
                        continue
                    stats, (least, most, _) = chunk.getStatistics(), seen[at]
                    if stats is None or stats.isEmpty() or not stats.isNumNullsSet():
                        seen[at][2] = None
                    elif seen[at][2] is not None:
                        seen[at][2] += stats.getNumNulls()
                    if stats is not None and stats.hasNonNullValue() and columns[at] is not None:
                        text = isinstance(columns[at], T.StringType)
                        least.append(stats.genericGetMin().toStringUsingUTF8() if text else stats.genericGetMin())
                        most.append(stats.genericGetMax().toStringUsingUTF8() if text else stats.genericGetMax())
                    elif stats is None or stats.isEmpty() or stats.getNumNulls() < chunk.getValueCount():
                        least.append(None)
                        most.append(None)
        finally:
            reader.close()
        known = lambda values, pick: pick(values) if values and None not in values else None
        return rows, {c: (known(least, min), known(most, max), nulls) for c, (least, most, nulls) in seen.items()}

    def files(self, folder: str) -> list[tuple[str, int, float]]:
        """Path below the root, size, and time of the last change of all files below ``folder``."""
        path, out = self._path(folder), []
        if not self._fs.exists(path):
            return out
        skip, walk = len(self._fs.makeQualified(self._path("")).toUri().getPath()) + 1, self._fs.listFiles(path, True)
        while walk.hasNext():
            s = walk.next()
            out.append((s.getPath().toUri().getPath()[skip:], s.getLen(), s.getModificationTime() / 1000))
        return out

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
