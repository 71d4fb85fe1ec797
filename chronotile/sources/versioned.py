"""A keyed table of versions (S8, S15): Parquet parts that never change, and a commit file for each version.

A write puts its rows into a new part folder and then commits: the commit file ``_commits/<number>`` lists the parts of that
version and is written under another name and moved into place, where no file of that number may exist yet. A reader takes
the highest number, so it sees the table before or after a write and never half of it; the parts of older versions stay, so a
plan that was made on one keeps its rows. A write that fails leaves a part that no commit lists. Two writers that
race for one number: the later one fails and may be repeated.

``append_new`` adds rows whose key the table lacks, ``upsert`` replaces those it has, ``replace`` swaps the whole table.
Keys match null-safely; of several rows with one key in a batch the one with the greatest digest of its columns stays, so
that reruns agree. A ``token`` (a stream's name and batch number) makes a repeated batch a no-op.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"


class Conflict(RuntimeError):
    """Another writer took the version number."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    # ---- commits

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        store, at = self._at(COMMITS)
        if not store.exists(at):
            return []
        names = [f.getPath().getName() for f in store.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def commit_of(self, version: int | None = None) -> dict:
        """The version's number, parts and tokens; the newest by default, an empty one before the first write."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "parts": [], "tokens": {}}
        if version is not None and version not in found:
            raise ValueError(f"no version {version} of {self.path}")
        number = found[-1] if version is None else version
        store, at = self._at(f"{COMMITS}/{number:012d}")
        stream = store.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: dict, parts: list[str], token: tuple[str, int] | None) -> int:
        number = base["version"] + 1
        tokens = {**base["tokens"], **({token[0]: token[1]} if token else {})}
        text = json.dumps({"version": number, "parts": parts, "tokens": tokens})
        store, temp = self._at(f"{COMMITS}/.{uuid.uuid4().hex}.tmp")
        _, final = self._at(f"{COMMITS}/{number:012d}")
        out = store.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, final, none)  # fails if the number is taken
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.path} was written meanwhile") from e
            raise
        return number

    # ---- reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first write."""
        parts = self.commit_of(version)["parts"]
        return self._rows(parts)

    def _rows(self, parts: list[str]) -> DataFrame | None:
        if not parts:
            return None
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(f"{self.path}/{p}") for p in parts])

    # ---- writing

    def _part(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return name

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """One row for each key, by an aggregate that combines before the shuffle."""
        rest = [c for c in rows.columns if c not in self.keys]
        if not rest:
            return rows.distinct()
        whole = [F.col(f"`{c}`") for c in rest]
        row, held = F.struct(*whole), "_" + max(rows.columns, key=len)
        picked = rows.groupBy(*self.keys).agg(F.max_by(row, F.struct(F.xxhash64(*whole), F.xxhash64(F.lit("chronotile"), *whole))).alias(held))
        return picked.select(*[F.col(c) if c in self.keys else F.col(f"`{held}`")[c].alias(c) for c in rows.columns])

    def _without(self, rows: DataFrame, other: DataFrame) -> DataFrame:
        """Rows whose key is not among the other's: a null-safe left-anti join on the keys alone."""
        a, b = rows.alias("a"), other.select(*self.keys).alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        return a.join(b, reduce(lambda x, y: x & y, same), "left_anti")

    def _seen(self, base: dict, token: tuple[str, int] | None) -> bool:
        return token is not None and base["tokens"].get(token[0], -1) >= token[1]

    def append_new(self, rows: DataFrame, token: tuple[str, int] | None = None) -> int:
        """Add the rows whose key the table lacks, as one part; returns the version that holds them."""
        base = self.commit_of()
        if self._seen(base, token):
            return base["version"]
        have = self._rows(base["parts"])
        new = self._one_each(rows)
        part = self._part(new if have is None else self._without(new, have))
        return self._commit(base, [*base["parts"], part], token)

    def upsert(self, rows: DataFrame, token: tuple[str, int] | None = None) -> int:
        """Add the rows and drop the table's rows of the same keys. The kept rows are written anew, in one part with them."""
        base = self.commit_of()
        if self._seen(base, token):
            return base["version"]
        have = self._rows(base["parts"])
        new = self._one_each(rows)
        part = self._part(new if have is None else self._without(have, new).unionByName(new, allowMissingColumns=True))
        return self._commit(base, [part], token)

    def replace(self, rows: DataFrame) -> int:
        """The whole table anew. No rows raise, and the table stays as it was."""
        base = self.commit_of()
        part = self._part(self._one_each(rows))
        if self.spark.read.parquet(f"{self.path}/{part}").isEmpty():
            raise ValueError(f"nothing to write to {self.path}")
        return self._commit(base, [part], None)

    def sink(self, name: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch is prepared and its new keys appended, once, however often it is repeated."""

        def run(batch: DataFrame, number: int) -> None:
            if not self._seen(self.commit_of(), (name, number)):
                self.append_new(prepare(batch), (name, number))

        return run
