"""Publishing outputs in any file system that Spark knows: they are staged beside their place and renamed into it, so a
failed run leaves what was there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class Place:
    """A path and its file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.at = self.fs.makeQualified(at)
        self.name = self.at.getName()

    def __str__(self) -> str:
        return self.path

    def sibling(self, name: str) -> Place:
        return Place(self.spark, f"{self.at.getParent()}/{name}")

    def child(self, name: str) -> Place:
        return Place(self.spark, f"{self.at}/{name}")

    def exists(self) -> bool:
        return self.fs.exists(self.at)

    def is_folder(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.at).isDirectory()

    def children(self) -> list[Place]:
        return sorted((Place(self.spark, str(x.getPath())) for x in self.fs.listStatus(self.at)), key=lambda p: p.name)

    def rename(self, other: Place) -> None:
        if not self.fs.rename(self.at, other.at):
            raise OSError(f"can't rename '{self.at}' to '{other.at}'")

    def remove(self) -> None:
        if self.exists():
            self.fs.delete(self.at, True)

    def write(self, head: bytes, parts: Iterable[Place] = ()) -> None:
        """Makes a file of some bytes and the files `parts`, which the driver's JVM copies one after the other."""
        conf = self.spark._jsc.hadoopConfiguration()
        out = self.fs.create(self.at)
        try:
            out.write(bytearray(head))
            for part in parts:
                source = part.fs.open(part.at)
                try:
                    self.spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
        finally:
            out.close()


def check_output(spark: SparkSession, output: str, overwrite: bool, inputs: tuple[str, ...] = (), folder: bool = False, make_parent: bool = False) -> Place:
    """The output's place. Its parent must exist (or is made); it must not be or hold an input."""
    place = Place(spark, output)
    parent = Place(spark, str(place.at.getParent()))
    if make_parent:
        parent.fs.mkdirs(parent.at)
    if not parent.is_folder():
        raise FileNotFoundError(f"folder '{parent.at}' doesn't exist")
    for name in inputs:
        other = str(Place(spark, name).at)
        if other == str(place.at) or (folder and other.startswith(f"{place.at}/")):
            raise ValueError(f"'{output}' would replace the input '{name}'")
    if place.exists() and not overwrite:
        raise FileExistsError(f"'{output}' exists already")
    return place


def published(output: Place, make: Callable[[Place], object]) -> object:
    """Calls make with a staged place and renames what it made into the output's; what was there comes back if that fails."""
    token = uuid.uuid4().hex
    staged, backup = output.sibling(f".{output.name}.{token}.new"), output.sibling(f".{output.name}.{token}.old")
    try:
        out = make(staged)
        had = output.exists()
        if had:
            output.rename(backup)
        try:
            staged.rename(output)
        except Exception:
            if had:
                backup.rename(output)
            raise
        if had:
            backup.remove()
        return out
    finally:
        staged.remove()
