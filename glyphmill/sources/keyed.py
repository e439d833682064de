"""A stored table with one row for each key, merged in place bucket by bucket.

Rows lie in buckets by a hash of their key. A merge reads and rewrites only the buckets that new keys fall into; the files of
the others stay as they are, under their names. A manifest names the folder of every bucket; making the next manifest is what
commits a merge, and of two merges that began from the same manifest one fails. Readers see one manifest, old or new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.embedding import Embedder
from glyphmill.scratch import materialize, remove, ship_package
from glyphmill.sources.pairs import upsert
from glyphmill.worker import key_of


class MergeConflict(RuntimeError):
    """Another merge was committed in the meantime."""


class KeyedTable:
    """The table at ``path``, of rows with the columns of ``schema``, one for each value of ``key``.

    A bucket is rewritten by one task; ``buckets`` is fixed when the table is first written and should keep them near 128 MB.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._system = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._manifest()[1].get("of", buckets)

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest(self) -> tuple[int, dict]:
        """The number and content of the latest manifest; one that is still being written doesn't count."""
        if not self._system.exists(self._at):
            return -1, {}
        names = sorted(s.getPath().getName() for s in self._system.listStatus(self._at) if s.getPath().getName().startswith("manifest-"))
        for name in reversed(names):
            opened = self._system.open(self._file(name))
            try:
                return int(name[9:-5]), json.loads(bytes(opened.readAllBytes()))
            except ValueError:
                continue
            finally:
                opened.close()
        return -1, {}

    def _commit(self, number: int, content: dict) -> None:
        try:
            out = self._system.create(self._file(f"manifest-{number:010d}.json"), False)
        except Exception as e:
            raise MergeConflict(f"'{self.path}' was merged by another job in the meantime") from e
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def folders(self) -> dict[int, str]:
        """Where each bucket that has rows lies."""
        return {int(b): f"{self.path}/{name}" for b, name in self._manifest()[1].get("folders", {}).items()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def rows(self) -> DataFrame:
        return self._read(list(self.folders().values()))

    def merge(self, new: DataFrame) -> int:
        """Rows of ``new`` replace those with their key, the rest stay; returns how many rows ``new`` has.

        Of new rows that share a key the largest one, by its columns in order, counts. A null key is a key. Without
        new rows nothing is written. A merge that dies leaves the table as it was.
        """
        number, manifest = self._manifest()
        names = self.schema.names
        place = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        others = [c for c in names if c != self.key]
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        new = materialize(new.withColumn("_bucket", place), "merged")
        counts = {r["_bucket"]: r["n"] for r in new.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # one row a bucket
        if not counts:
            return 0
        once = new.groupBy(self.key).agg(F.max(F.struct(*others)).alias("_row")).select(self.key, *[F.col(f"_row.{c}").alias(c) for c in others])
        had = manifest.get("folders", {})
        existing = self._read([f"{self.path}/{had[str(b)]}" for b in counts if str(b) in had])
        version = uuid.uuid4().hex
        upsert(existing, once, self.key).select(*names).withColumn("_bucket", place).repartition(min(len(counts), 4096), "_bucket").write.partitionBy(
            "_bucket"
        ).parquet(f"{self.path}/{version}")
        folders = {**had, **{str(b): f"{version}/_bucket={b}" for b in counts}}
        self._commit(number + 1, {"of": self.buckets, "folders": folders})
        return sum(counts.values())

    def clean(self) -> None:
        """Remove what the latest manifest doesn't name: replaced buckets and merges that died. Not while others read or merge."""
        number, manifest = self._manifest()
        used = set(manifest.get("folders", {}).values())
        for status in self._system.listStatus(self._at):
            name = status.getPath().getName()
            if not status.isDirectory():
                if name != f"manifest-{number:010d}.json":
                    remove(self.spark, f"{self.path}/{name}")
                continue
            inside = [f"{name}/{s.getPath().getName()}" for s in self._system.listStatus(status.getPath()) if s.isDirectory()]
            for folder in inside:
                if folder not in used:
                    remove(self.spark, f"{self.path}/{folder}")
            if not used.intersection(inside):
                remove(self.spark, f"{self.path}/{name}")


def embed_stored(df: DataFrame, embedder: Embedder, store: str, text: str = "text", out: str = "vec", buckets: int = 64) -> tuple[DataFrame, int]:
    """``df`` with the vectors of its texts, and how many texts were embedded for it: those that the store at ``store`` lacks.

    The store holds a vector for each digest of a text and each embedder, by its content. Equal texts are embedded once; a null text counts as an empty
    one, as for the embedder. ``df`` is computed twice. A column named ``out`` is replaced.
    """
    ship_package()
    spark = df.sparkSession
    table = KeyedTable(spark, store, "digest string, vec array<double>", "digest", buckets)
    content = F.coalesce(F.col(text), F.lit(""))
    # The embedder is part of the digest, so that one store serves several.
    digest = F.sha2(F.concat(F.lit(key_of(embedder) + ":"), content), 256)
    texts = df.select(digest.alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    missing = texts.join(table.rows().select("digest"), "digest", "left_anti")
    missing = missing.repartition(spark.sparkContext.defaultParallelism, "digest")
    embedded = table.merge(missing.select("digest", embedder.as_column(F.col("content")).alias("vec")))
    vectors = table.rows().select(F.col("digest").alias("_digest"), F.col("vec").alias("_vec"))
    kept = [c for c in df.columns if c != out]
    return df.join(vectors, digest == F.col("_digest"), "left").select(*kept, F.col("_vec").alias(out)), embedded
