"""A vector index as snapshots of Parquet files: append, delete, back up, restore."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.operators.common import small
from larkdoc.operators.vectors import knn_l2, metadata_filter


class ChunkIndex:
    """Chunks with embeddings under one folder: parts that never change, and versions that list parts; the newest version is the index.

    An append writes the new rows as a part, a deletion writes anew only the parts that hold rows to
    remove; either then writes a version. Older versions and parts stay, so a lost executor or a failed
    write leaves the last version whole, and readers are not disturbed. ``compact`` makes one part of all.

    ``layout`` names metadata columns, as the owner and the chat, by whose values a part's files lie in folders; searches and
    deletions that ask for values of them, and ``rows_of``, read these folders only. An index keeps the layout it was begun with.
    """

    def __init__(self, spark: SparkSession, root: str, layout: tuple[str, ...] = ()):
        self.spark, self.root, self.layout = spark, root, layout

    def _folders(self, rows: DataFrame) -> dict[str, Column]:
        """The folders' columns: values as text, as ``metadata_filter`` compares them, behind a letter so that none is read as a number."""
        return {f"in_{c}": F.concat(F.lit("v"), F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in rows.columns else F.lit("None")) for c in self.layout}

    def _narrowed(self, rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
        """``rows`` of the folders that can hold what is ``wanted``; a filter of partitions."""
        for c in self.layout:
            if c in wanted:
                values = wanted[c] if isinstance(wanted[c], (list, tuple, set)) else [wanted[c]]
                rows = rows.where(F.col(f"in_{c}").isin([f"v{v}" for v in values]))
        return rows

    def _names(self, folder: str, prefix: str) -> list[str]:
        """Names of finished folders in ``folder``, sorted."""
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path_of(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path_of(folder)):
            return []
        found = [status.getPath() for status in files.listStatus(path_of(folder))]
        return sorted(p.getName() for p in found if p.getName().startswith(prefix) and files.exists(path_of(p, "_SUCCESS")))

    def versions(self) -> list[str]:
        return self._names(self.root, "version=")

    def parts(self, version: str | None = None) -> list[str]:
        """Names of the parts of a version, of the newest one if none is named."""
        found = [version] if version else self.versions()[-1:]
        return [r["part"] for v in found for r in self.spark.read.schema("part string").parquet(f"{self.root}/{v}").collect()]

    def _read(self, parts: list[str]) -> DataFrame | None:
        if not parts:
            return None
        if not self.layout:
            return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/parts/{p}" for p in parts))
        columns = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/columns/{p}" for p in parts)).schema  # an empty part has no file of its own
        return self.spark.read.schema(columns).option("basePath", f"{self.root}/parts").parquet(*(f"{self.root}/parts/in_part={p}" for p in parts))

    def _plain(self, rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.drop("in_part", *(f"in_{c}" for c in self.layout))

    def read(self, version: str | None = None) -> DataFrame | None:
        return self._plain(self._read(self.parts(version)))

    def rows_of(self, scopes: DataFrame) -> DataFrame | None:
        """The rows of each of ``scopes``, which has the layout's columns and any others; folders are picked as the scopes are known, while the job runs."""
        held = self._read(self.parts())
        if held is None:
            return None
        asked = scopes.withColumns(self._folders(scopes)).drop(*self.layout)
        return self._plain(held.join(small(asked), [f"in_{c}" for c in self.layout]))

    def _publish(self, kept: list[str], rows: DataFrame) -> str:
        """A new version of the parts ``kept`` and one of ``rows``."""
        part = uuid.uuid4().hex
        if self.layout:
            folders = self._folders(rows)
            placed = rows.withColumns(folders)
            placed.repartition(*folders).write.partitionBy(*folders).parquet(f"{self.root}/parts/in_part={part}")
            placed.limit(0).coalesce(1).write.parquet(f"{self.root}/columns/{part}")
        else:
            rows.write.parquet(f"{self.root}/parts/{part}")
        number = int(self.versions()[-1].removeprefix("version=")) + 1 if self.versions() else 1
        self.spark.createDataFrame([(p,) for p in (*kept, part)], "part string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/version={number:010d}")
        return f"version={number:010d}"

    def write(self, rows: DataFrame) -> str:
        return self._publish([], rows)

    def compact(self) -> None:
        if (held := self.read()) is not None:
            self.write(held)

    def append(self, rows: DataFrame, overwrite: bool = False) -> int:
        """Adds rows; a different vector length is an error unless ``overwrite``, which replaces the index. Returns the rows added.

        Columns that only one side has are null on the other; where a column's type differs from the
        index's, all rows are written anew in a type that holds both.
        """
        held = self.read()
        size = lambda df: df.select(F.size("embedding").alias("n")).first()
        if held is not None and not overwrite and (a := size(held)) and (b := size(rows)) and a["n"] != b["n"]:
            raise ValueError(f"vectors of length {b['n']} don't fit an index of length {a['n']}")
        if held is None or overwrite:
            self.write(rows)
        elif all(rows.schema[c].dataType.simpleString() == held.schema[c].dataType.simpleString() for c in set(rows.columns) & set(held.columns)):
            self._publish(self.parts(), rows)
        else:
            self.write(held.unionByName(rows, allowMissingColumns=True))
        return self._read(self.parts()[-1:]).count() if held is None or overwrite else self.count() - held.count()

    def delete(self, wanted: dict[str, object]) -> int:
        """Removes rows by metadata, keeping the others' vectors; returns how many went."""
        parts = self.parts()
        if not parts:
            return 0
        part = F.regexp_extract("_metadata.file_path", r"/parts/(?:in_part=)?([0-9a-f]+)/", 1)
        hits = {r["_part"]: r["n"] for r in metadata_filter(self._narrowed(self._read(parts), wanted).withColumn("_part", part), wanted).groupBy("_part").agg(F.count("*").alias("n")).collect()}
        if hits:
            self._publish([p for p in parts if p not in hits], self._plain(metadata_filter(self._read(list(hits)), wanted, keep=False)))
        return sum(hits.values())

    def status(self, backups: str) -> DataFrame:
        """One row (document_count, backup_root_dir)."""
        return self.spark.createDataFrame([(self.count(), backups)], "document_count long, backup_root_dir string")

    def clear(self) -> None:
        if (held := self.read()) is not None:
            self.write(held.limit(0))

    def count(self) -> int:
        held = self.read()
        return 0 if held is None else held.count()

    def search(self, queries: DataFrame, k: int, wanted: dict[str, object] | None = None) -> DataFrame | None:
        held = self._read(self.parts())
        return None if held is None else knn_l2(queries, self._plain(self._narrowed(held, wanted or {})), k, wanted)

    def backup(self, folder: str, stamp: str) -> DataFrame:
        """Copies the index to ``folder``/backup_``stamp``; one row (backed_up, reason, document_count)."""
        held = self.read()
        if held is None:
            return self._report("backed_up", False, "no index", 0)
        held.write.mode("overwrite").parquet(f"{folder}/backup_{stamp}")
        return self._report("backed_up", True, None, held.count())

    def restore_latest(self, folder: str) -> DataFrame:
        """Makes the backup with the greatest name the index; one row (restored, reason, document_count)."""
        names = self._names(folder, "backup_")
        if not names:
            return self._report("restored", False, "no backup", 0)
        self.write(self.spark.read.parquet(f"{folder}/{names[-1]}"))
        return self._report("restored", True, None, self.count())

    def _report(self, name: str, done: bool, reason: str | None, n: int) -> DataFrame:
        return self.spark.createDataFrame([(done, reason, n)], f"{name} boolean, reason string, document_count long")
