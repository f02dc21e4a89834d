"""Tables on shared storage: whole versions and changes to them, and lineage cuts."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.blocks import bucket
from claimweave.functions.schema import CLAIM, DOCUMENT, MEASURE, RELATION, columns, conform


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the session's shared checkpoint folder; only where none is set and all runs on one machine, as in tests, to a local one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the checkpoints, in which tables can be written too."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimweave-"))
    return context._jsc.sc().getCheckpointDir().get()


def bounded(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """Write df and, if it has most_rows rows at most, mark it for broadcasting; else a join with it shuffles."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Changes that a table holds before they are merged into a whole version, and the buckets of a dealt table.
MERGE_AFTER, BUCKETS = 16, 64
#: Each table's columns, its key, and what an upsert leaves as it was.
TABLES = {
    "documents": (DOCUMENT, ("doc_id",), ("filename", "path")),
    "claims": (CLAIM, ("id",), ()),
    "relations": (RELATION, ("claim_a_id", "claim_b_id"), ("id", "cross_doc")),
    "measures": (MEASURE, ("key",), ()),
    "decisions": ("a string, b string, same boolean", ("a", "b"), ()),
    "responses": ("key string, response string", ("key",), ()),
}
#: Tables whose rows are dealt into folders, so that some can be read without the others: claims by their block.
DEALT = {"claims": bucket}


class VersionTaken(RuntimeError):
    """Another writer replaced or changed the table meanwhile."""


@dataclass
class Store:
    """Parquet tables under one folder, as versions that are whole or hold what changed.

    A write adds a whole version, an upsert one of its rows alone, so what it costs is in proportion to them; a change
    also holds tombstones, the keys that it removes. Reading merges the last whole version with the changes after it.
    After MERGE_AFTER changes an upsert writes a whole version, and versions before the last whole one but one are
    removed, so readers of that one can go on.

    Each version is written to a folder of its own, and counts once the log has its number, for which a file is made
    that must not exist yet. Of two writers that come to one number, the one that upserts takes the next, and the one
    that replaces the table fails, as what it read is no longer what is there.
    """

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, name: str) -> list[tuple[int, bool, str]]:
        """(version, whether it is whole, its folder), from the last whole one on, in order."""
        files, log = self._files(f"{self.root}/{name}/log")
        if not files.exists(log):
            return []
        found = []
        for status in files.listStatus(log):
            stream = files.open(status.getPath())
            entry = json.loads(bytes(stream.readAllBytes()).decode() or "null")
            stream.close()
            if entry:  # else its writer stopped within the line
                found.append((int(status.getPath().getName()), entry["whole"], entry["folder"]))
        found.sort()
        last = max((v for v, whole, _ in found if whole), default=0)
        return [x for x in found if x[0] >= last]

    def _log(self, name: str, version: int, whole: bool, folder: str) -> bool:
        """Whether the version's number was free."""
        files, path = self._files(f"{self.root}/{name}/log/{version:09d}")
        try:
            stream = files.create(path, False)
        except Py4JJavaError:
            if files.exists(path):
                return False
            raise
        stream.write(bytearray(json.dumps({"whole": whole, "folder": folder}).encode()))
        stream.close()
        return True

    def read(self, name: str, buckets: list[int] | None = None, wanted: list[str] | None = None) -> DataFrame:
        """The table's rows; buckets: of a dealt table, those of some buckets alone, for which no other folder is read.

        wanted: the columns that are needed, in the table's order; the others aren't read, nor written where changes are merged.
        """
        ddl = _only(name, wanted)
        parts = [(self._part(name, folder, buckets), whole) for _, whole, folder in self._versions(name)]
        if not parts:
            return self.spark.createDataFrame([], ddl)
        if len(parts) == 1 and parts[0][1]:
            return conform(parts[0][0], ddl)
        return merged([df for df, _ in parts], name, wanted)

    def _part(self, name: str, folder: str, buckets: list[int] | None = None) -> DataFrame:
        ddl = f"{TABLES[name][0]}, gone boolean" + (", bucket int" if name in DEALT else "")
        df = self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/{folder}")
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        return df.drop("bucket")

    def buckets_of(self, name: str, keys: DataFrame) -> list[int]:
        """Of a dealt table, the buckets with rows that share the one column of keys: a scan of that column alone."""
        column = keys.columns[0]
        found = None
        for _, _, folder in self._versions(name):
            df = self.spark.read.schema(f"{column} {keys.schema[column].dataType.simpleString()}, bucket int").parquet(f"{self.root}/{name}/{folder}")
            found = df if found is None else found.unionByName(df)
        return [] if found is None else sorted(r.bucket for r in found.join(keys, column, "left_semi").select("bucket").distinct().collect())

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        if name in DEALT:
            df.withColumn("bucket", F.coalesce("bucket", DEALT[name](self.buckets))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        else:
            df.drop("bucket").write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def _rows(self, name: str, df: DataFrame, gone: bool) -> DataFrame:
        """df as rows of a version; of rows that go, the key stays and the bucket in which they were."""
        ddl, key, _ = TABLES[name]
        rows = conform(df, ddl).withColumns({"gone": F.lit(gone), "bucket": F.lit(None).cast("int")})
        if not gone:
            return rows
        if name in DEALT:
            rows = rows.withColumn("bucket", DEALT[name](self.buckets))
        return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c not in (*key, "gone", "bucket")})

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table. The new version counts once its line is in the log."""
        before = self._versions(name)
        folder = self._write(name, self._rows(name, df, gone=False))
        if not self._log(name, max((v for v, _, _ in before), default=0) + 1, True, folder):
            raise VersionTaken(f"{name} was changed while it was replaced")
        if wholes := [v for v, whole, _ in before if whole]:
            self._remove(name, wholes[0])

    def upsert(self, name: str, df: DataFrame, gone: DataFrame | None = None, unique: bool = False) -> DataFrame:
        """Insert rows, and replace those with a known key but for the columns that the table keeps; of equal keys in df one row counts.

        gone: rows as they are stored, whose keys are removed, but for keys that df holds. Rows of a dealt table that df
        moves to another bucket must be among them, for readers of the bucket that they leave. unique: neither frame has
        a key twice, so that they are written as they come. Returns the rows of df as they were written.
        """
        once = lambda rows, *key: rows if unique else rows.dropDuplicates(list(key))
        rows = self._rows(name, once(df, *TABLES[name][1]), gone=False)
        if gone is not None:
            rows = rows.unionByName(once(self._rows(name, gone, gone=True), *TABLES[name][1], "bucket"))
        folder = self._write(name, rows)
        version = max((v for v, _, _ in self._versions(name)), default=0) + 1
        while not self._log(name, version, False, folder):
            version += 1
        if sum(not whole for _, whole, _ in self._versions(name)) > MERGE_AFTER:
            try:
                self.write(name, self.read(name))
            except VersionTaken:
                pass  # the next upsert merges
        return conform(self._part(name, folder).where("not gone"), TABLES[name][0])

    def _remove(self, name: str, before: int) -> None:
        """Delete the versions before this one, and their lines."""
        files, log = self._files(f"{self.root}/{name}/log")
        keep = {}
        for status in files.listStatus(log):
            stream = files.open(status.getPath())
            keep[int(status.getPath().getName())] = (status.getPath(), json.loads(bytes(stream.readAllBytes()).decode() or "null"))
            stream.close()
        for version, (path, entry) in keep.items():
            if version < before:
                if entry:
                    files.delete(self._files(f"{self.root}/{name}/{entry['folder']}")[1], True)
                files.delete(path, False)

    def delete_documents(self, doc_ids: DataFrame) -> None:
        """Remove documents with their claims; relations follow."""
        from claimweave.plans.changes import apply

        gone = bounded(doc_ids.select("doc_id").distinct())
        claims = checkpointed(self.read("claims").join(gone, "doc_id", "left_semi"))
        apply(self, claims.limit(0), claims)
        self.upsert("documents", self.read("documents").limit(0), self.read("documents").join(gone, "doc_id", "left_semi"))


def _only(name: str, wanted: list[str] | None) -> str:
    """The table's columns, or its key and those that are wanted."""
    ddl, key, _ = TABLES[name]
    return ddl if wanted is None else ", ".join(f"{c} {kind}" for c, kind in columns(ddl) if c in key or c in wanted)


def merged(versions: list[DataFrame], name: str, wanted: list[str] | None = None) -> DataFrame:
    """Rows of the newest version of each key, if that isn't a tombstone; columns that the table keeps have their oldest value.

    The first version is the large one: it only loses the keys of later ones, which are broadcast if they are few, so
    its rows aren't shuffled. What is kept starts anew after a tombstone. wanted: the columns that are needed. Changes
    are sorted once.
    """
    (_, key, fixed), ddl = TABLES[name], _only(name, wanted)
    names = [c for c, _ in columns(ddl)]
    fixed = tuple(c for c in fixed if c in names)
    flagged = [(df if "gone" in df.columns else df.withColumn("gone", F.lit(False))).select(*names, "gone") for df in versions]
    first = flagged[0].where("not gone")
    if len(flagged) == 1:
        return conform(first, ddl)
    changes = None
    for k, df in enumerate(flagged[1:]):  # a row and a tombstone of one version: the row counts
        df = df.withColumn("_order", 2 * F.lit(k) + (~F.col("gone")).cast("int"))
        changes = df if changes is None else changes.unionByName(df)
    order = Window.partitionBy(*key).orderBy("_order")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    changes = changes.withColumns({"_gone": F.max(F.when(F.col("gone"), F.col("_order"))).over(whole), "_next": F.lead("_order").over(order)})
    for c in fixed:
        changes = changes.withColumn(f"_{c}", F.first(F.when(F.col("_order") > F.coalesce("_gone", F.lit(-1)), F.struct(c)), ignorenulls=True).over(whole))
    last = checkpointed(changes.where("_next is null"))
    keys = bounded(last.select(*key))
    put = last.where("not gone")
    if fixed:
        had = first.join(keys, list(key), "left_semi").select(*key, F.struct(*fixed).alias("_had"))
        put = put.join(had, list(key), "left")
        put = put.withColumns({c: F.when(F.col("_gone").isNull() & F.col("_had").isNotNull(), F.col(f"_had.{c}")).otherwise(F.col(f"_{c}.{c}")) for c in fixed})
    return conform(first.join(keys, list(key), "left_anti"), ddl).unionByName(conform(put, ddl))


def unseen_documents(incoming: DataFrame, store: Store) -> DataFrame:
    """Documents whose id isn't stored."""
    return incoming.join(store.read("documents").select("doc_id"), "doc_id", "left_anti")
