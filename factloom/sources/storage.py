"""Folders of any store that Spark writes to: staged, then moved to their place in one step."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


class Store:
    """A few file operations of Hadoop's file system, at whose steps nothing is half done."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._new_array = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway.new_array

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if it isn't there."""
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def make(self, folder: str) -> None:
        p, fs = self._at(folder)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file; one that is there is an error."""
        p, fs = self._at(path)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str, replace: bool = False) -> None:
        """One rename; a target that is there is an error, or is replaced in the same step."""
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        (a, fs), (b, _) = self._at(source), self._at(target)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(a, b, options)


class Generation:
    """The outputs of one run, which appear all at once or not at all.

    What is written goes to a hidden folder beside the target; ``publish`` moves
    it there by one rename. A target that is there is an error, before anything is
    written and again when it is published. A run that fails leaves nothing.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.store, self.target = Store(spark), target.rstrip("/")
        parent, _, name = self.target.rpartition("/")
        self.stage, self.published = f"{parent}/.{name}.staging-{uuid.uuid4().hex}", False
        self._absent()

    def _absent(self) -> None:
        if self.store.exists(self.target):
            raise FileExistsError(f"{self.target} is there already; choose a new folder")

    def __enter__(self) -> Generation:
        self.store.make(self.stage)
        return self

    def table(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.stage}/{name}")

    def text(self, name: str, text: str) -> None:
        self.store.create(f"{self.stage}/{name}", text)

    def publish(self) -> str:
        self._absent()
        self.store.move(self.stage, self.target)
        self.published = True
        return self.target

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if not self.published:
            self.store.delete(self.stage)


class Versions:
    """A folder of generations of which one is current, named by a pointer file.

    A new generation is staged, moved beside the others, and becomes current when
    the pointer is replaced, in one rename: readers see the old one whole, then
    the new one whole. A failure at any step leaves the pointer where it was and
    takes the new generation away. ``clear`` removes what the pointer doesn't name.
    """

    POINTER = "CURRENT"

    def __init__(self, spark: SparkSession, root: str, move: Callable[..., None] | None = None):
        self.spark, self.store, self.root = spark, Store(spark), root.rstrip("/")
        self.move = move or self.store.move

    def current(self) -> str | None:
        pointer = f"{self.root}/{self.POINTER}"
        return f"{self.root}/{self.store.read(pointer).strip()}" if self.store.exists(pointer) else None

    def publish(self, tables: dict[str, DataFrame], texts: dict[str, str] | None = None) -> str:
        """The folder of a new current generation that holds ``tables`` and ``texts``."""
        name = uuid.uuid4().hex
        target, pointer = f"{self.root}/generation-{name}", f"{self.root}/.{self.POINTER}-{name}"
        self.store.make(self.root)
        with Generation(self.spark, target) as new:
            for key, df in tables.items():
                new.table(df, key)
            for key, text in (texts or {}).items():
                new.text(key, text)
            try:
                self.move(new.stage, target)
                new.published = True
                self.store.create(pointer, target.rpartition("/")[2])
                self.move(pointer, f"{self.root}/{self.POINTER}", replace=True)
            except BaseException:
                self.store.delete(pointer)
                self.store.delete(target)
                raise
        return target

    def clear(self) -> list[str]:
        """Removes generations and stages that aren't current; their names. Not while another run publishes here."""
        kept = {self.POINTER, (self.current() or "").rpartition("/")[2]}
        stale = [n for n in self.store.names(self.root) if n not in kept and n.startswith(("generation-", ".generation-", f".{self.POINTER}-"))]
        for n in stale:
            self.store.delete(f"{self.root}/{n}")
        return stale


def publish_both(spark: SparkSession, articles: DataFrame, out: str, artifact: str | None = None, move: Callable[..., None] | None = None) -> None:
    """Final articles at ``out``, and at ``artifact`` if it is another place: at both or at neither.

    Old articles at either place go first, so that a run that fails leaves none.
    Both are staged before either is moved; if the second can't be, the first goes.
    """
    store, places = Store(spark), list(dict.fromkeys(p.rstrip("/") for p in (out, artifact) if p))
    move = move or store.move
    for p in places:
        store.delete(p)
    stages = [f"{p.rpartition('/')[0]}/.{p.rpartition('/')[2]}.staging-{uuid.uuid4().hex}" for p in places]
    done: list[str] = []
    try:
        for s in stages:
            articles.write.parquet(s)
        for s, p in zip(stages, places, strict=True):
            move(s, p)
            done.append(p)
    except BaseException:
        for p in done:
            store.delete(p)
        raise
    finally:
        for s in stages:
            store.delete(s)
