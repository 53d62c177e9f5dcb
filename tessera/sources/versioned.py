"""Tables that many may read and write at once: immutable data files under numbered manifests.

A version is a manifest that lists the files of each bucket of keys. A writer
makes new files for the buckets that its rows fall into and then creates the
next manifest; creating is atomic and fails where that number exists, so of two
writers who started from one version, the second is refused and loses nothing
of the first's. A reader holds a version's files, which nothing changes.

Rows carry a version too: an update names the one it expects, and where another
is stored it does not apply but goes to the table of conflicts. What was applied
is appended to the audit, in a folder named by the hash of what it says, so a
repeated commit adds nothing.

Layout: ``data/<name>/bucket=<n>``, ``manifests/<number>.json``, ``audit/<hash>``,
``conflicts/<hash>``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class VersionConflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    schema: str  # as JSON
    buckets: dict[int, str]  # folder of each bucket's rows


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, n_buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.n_buckets = spark, path.rstrip("/"), key, n_buckets

    # -- files ------------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, name: str, text: str) -> None:
        """A new file with all of the text at once; refused where the name is taken."""
        jvm, draft = self.spark._jvm, self._path("manifests", f".{uuid.uuid4().hex}")
        files = self._files()
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._path("manifests", name), options)
        except Exception as refused:
            files.delete(draft, False)
            raise VersionConflict(name) from refused

    def versions(self) -> list[int]:
        files, folder = self._files(), self._path("manifests")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        found = self.versions()
        if not found:
            return None
        number = found[-1] if number is None else number
        text = "\n".join(r["value"] for r in self.spark.read.text(str(self._path("manifests", f"{number:012d}.json").toString()), wholetext=True).collect())
        held = json.loads(text)
        return Snapshot(number, held["schema"], {int(k): v for k, v in held["buckets"].items()})

    # -- reading ----------------------------------------------------------------------------------
    def read(self, snapshot: Snapshot | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        from pyspark.sql.types import StructType

        snapshot = snapshot or self.snapshot()
        schema = StructType.fromJson(json.loads(snapshot.schema))
        folders = [f"{self.path}/{folder}" for k, folder in sorted(snapshot.buckets.items()) if only is None or k in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- writing ----------------------------------------------------------------------------------
    def bucket_of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.n_buckets)).cast("int"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return self.bucket_of(rows).repartition("bucket")

    def _write(self, dealt: DataFrame) -> dict[int, str]:
        name = f"data/{uuid.uuid4().hex}"
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        files = self._files()
        found = [s.getPath().getName() for s in files.listStatus(self._path(name))]
        return {int(f.removeprefix("bucket=")): f"{name}/{f}" for f in found if f.startswith("bucket=")}

    def _commit(self, base: Snapshot | None, schema: str, buckets: dict[int, str]) -> Snapshot:
        number = base.number + 1 if base else 0
        self._create(f"{number:012d}.json", json.dumps({"schema": schema, "buckets": buckets}, sort_keys=True))
        return Snapshot(number, schema, buckets)

    def create(self, rows: DataFrame) -> Snapshot:
        return self._commit(None, rows.schema.json(), self._write(self._dealt(rows)))

    def replace(self, base: Snapshot, rows: DataFrame, touched: list[int]) -> Snapshot:
        """The next version, where ``rows`` are all there is in the touched buckets and the others stay as they are."""
        return self._replaced(base, self._dealt(rows), touched)

    def _replaced(self, base: Snapshot, dealt: DataFrame, touched: list[int]) -> Snapshot:
        kept = {k: v for k, v in base.buckets.items() if k not in touched}
        return self._commit(base, base.schema, kept | self._write(dealt))

    def merge(self, updates: DataFrame, base: Snapshot | None = None) -> tuple[Snapshot, int]:
        """Applies updates to a version and makes the next one, or raises VersionConflict; how many updates were refused is returned.

        ``updates`` has the table's columns, ``expected`` in place of ``version``: the stored row's version, or
        0 for a row that is not there yet. Of several updates of a key the one with the smallest hash applies and the
        others conflict. Only buckets that the updates fall into are read and written.
        """
        from tessera.operators.staging import staged

        base = base or self.snapshot()
        columns = [c for c in self.read(base, []).columns if c != "version"]
        turn = F.row_number().over(_by(self.key, F.xxhash64(*(F.col(c) for c in (*columns, "expected")))))
        asked = staged(self.bucket_of(updates).withColumn("turn", turn), "updates")
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets at most
        stored = self.read(base, touched)
        known = stored.select(F.col(self.key).alias("_key_"), F.col("version").alias("_stored_"), F.xxhash64(*columns).alias("_before_"))
        met = asked.join(known, asked[self.key] == F.col("_key_"), "left")
        met = staged(met.withColumn("applies", (F.col("turn") == 1) & (F.col("expected") == F.coalesce("_stored_", F.lit(0)))), "decisions")
        applied = met.where("applies").select(*columns, (F.col("expected") + 1).cast(stored.schema["version"].dataType).alias("version"))
        # stored rows move once, to their buckets, and there give way to what was applied; null keys are nobody's
        both = self._dealt(stored.withColumn("_new_", F.lit(0)).unionByName(applied.withColumn("_new_", F.lit(1))))
        newest = both.withColumn("_newest_", F.max("_new_").over(W.partitionBy("bucket", self.key)))
        rows = newest.where(F.col(self.key).isNull() | (F.col("_new_") == F.col("_newest_"))).drop("_new_", "_newest_")
        refused = met.where("not applies").select(*columns, "expected", F.coalesce("_stored_", F.lit(0)).alias("stored"))
        made = self._replaced(base, rows, touched)
        moves = met.where("applies").select(F.col(self.key).cast("string").alias("key"), F.col("_before_").alias("before"), F.xxhash64(*columns).alias("after"), (F.col("expected") + 1).alias("version"), F.lit(made.number).alias("table_version"))
        self._append("audit", moves)
        return made, self._append("conflicts", refused)

    def _append(self, kind: str, rows: DataFrame) -> int:
        """Adds rows under the hash of what they say; nothing where they are there already."""
        said = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).collect()[0]  # one row
        if said["n"]:
            rows.write.mode("ignore").parquet(f"{self.path}/{kind}/{said['n']:x}-{int(said['h']) & (1 << 96) - 1:024x}")
        return said["n"]

    def appended(self, kind: str) -> DataFrame | None:
        files, folder = self._files(), self._path(kind)
        found = [f"{self.path}/{kind}/{s.getPath().getName()}" for s in files.listStatus(folder)] if files.exists(folder) else []
        return self.spark.read.parquet(*found) if found else None


def _by(key: str, order):
    return W.partitionBy(key).orderBy(order)
