"""Small files on any store that Spark reaches: lists, texts, and texts that are put only where none is yet."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Files below a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, under: str = "") -> list[str]:
        at = self.path(under)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def age(self, name: str) -> float | None:
        """Seconds since the file was written; None without one."""
        at = self.path(name)
        return (self.jvm.System.currentTimeMillis() - self.fs.getFileStatus(at).getModificationTime()) / 1000 if self.fs.exists(at) else None

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file where there is none; False if there is one. What is written appears whole, by a rename that overwrites nothing:
        two writers can't both succeed where the store's own rename is atomic."""
        made = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(made), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        at = self.path(name)
        self.fs.mkdirs(at.getParent())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(made), at, how)
            return True
        except Exception as error:
            self.fs.delete(self.path(made), False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise

    def move(self, name: str, to: str) -> bool:
        return self.fs.exists(self.path(name)) and self.fs.rename(self.path(name), self.path(to))

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
