"""Stored tables of one deployment: append-only ledgers and immutable dataset versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.functions.cleaning import quoted, to_time
from orderlight.operators.latest import latest_per_key
from orderlight.operators.snapshots import extended_snapshot, version_states
from orderlight.session import stored
from orderlight.sources.commits import commit, committed
from orderlight.sources.parts import MANIFEST, buckets_for, extend_parts, read_manifest, read_parts, write_parts
from orderlight.sources.schemas import LEDGERS, SNAPSHOT


def read_snapshot(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Snapshot by file kind: Parquet, or CSV (also gzipped) with header."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif name.endswith((".csv", ".csv.gz")):
        raw = spark.read.option("header", True).csv(path)
        known = {f.split()[0]: f.split()[1] for f in SNAPSHOT.split(",")}
        df = raw.select(*[
            to_time(raw, c).alias(c) if c == "created_at"
            else F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c)
            for c in raw.columns
        ])
    else:
        raise ValueError(f"Neither Parquet nor CSV: {path}")
    return df.select(*columns) if columns else df


class VersionTaken(Exception):
    """Another writer published a version meanwhile; what was built on the one before must be built again."""


@dataclass(frozen=True)
class Workspace:
    """Folder of tables. Any number of writers: uploads and versions are entered by commits, which only one writer of a
    name wins. Readers see only complete files."""

    spark: SparkSession
    root: str

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def ledger(self, name: str) -> DataFrame:
        """All appended and committed rows; columns added by later releases read as NULL in old files."""
        schema = LEDGERS[name]
        entered = committed(self.spark, self.path("commits", name), schema)
        try:
            rows = self.spark.read.schema(schema).parquet(self.path("ledger", name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = None
        found = [df for df in (rows, entered) if df is not None]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def commit(self, name: str, key: str, row: tuple) -> bool:
        """Enter one row under a key that only one writer can take."""
        return commit(self.spark, self.path("commits", name), key, LEDGERS[name], row)

    def append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        if isinstance(rows, list):
            rows = self.spark.createDataFrame(rows, LEDGERS[name]).coalesce(1)
        types = {f.split()[0]: f.split()[1] for f in LEDGERS[name].split(",")}
        rows.select(*[
            (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()
        ]).write.mode("append").parquet(self.path("ledger", name))

    def batches(self) -> DataFrame:
        """Current state per batch. All states of an attempt carry its upload time, so the step tells which is the last."""
        return latest_per_key(self.ledger("data_batches"), ["batch_id"], "uploaded_at", "step", "status")

    def versions(self) -> DataFrame:
        return version_states(self.ledger("dataset_versions"))

    def active_version(self) -> dict | None:
        row = self.versions().filter("active").first()
        return row.asDict() if row else None

    def snapshot(self, version: str | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """Orders of a version, or of the active one."""
        row = self.active_version() if version is None else self.versions().filter(F.col("dataset_version") == version).first()
        if row is None:
            return None
        path = row["processed_path"]
        df = read_parts(self.spark, [r["part"] for r in read_manifest(self.spark, path)] if self._listed(path) else [path])
        return df.select(*columns) if columns else df

    def _listed(self, path: str) -> bool:
        """Whether the version is a list of parts; those of earlier releases are one folder of orders."""
        return path.startswith(self.path("manifests", ""))

    def write_raw(self, items: DataFrame, batch_id: str) -> DataFrame:
        """Untouched copy of an upload, as text columns; returns it under the original names.
        The file uses plain column names, since source headers may hold any character."""
        plain = {
            c: c if c == "_ord" else f"c{i}_" + "".join(ch if ch.isalnum() else "_" for ch in c)
            for i, c in enumerate(items.columns)
        }
        path = self.path("bronze", f"batch_id={batch_id}")
        items.select(*[
            quoted(c).cast("bigint" if c == "_ord" else "string").alias(n) for c, n in plain.items()
        ]).write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path).select(*[F.col(n).alias(c) for c, n in plain.items()])

    def write_version(
        self, version: str, snapshot: DataFrame, quarantine: DataFrame, report: DataFrame,
        batch_id: str, at, sample: bool = False, unique_orders: bool = False, prepared: bool = False,
    ) -> dict:
        """Immutable snapshot, quarantine CSV and report JSON, then one version row. Being the
        newest full version makes it the active one. ``unique_orders`` says that the snapshot
        holds one row per order, which saves a distinct count; ``prepared`` that it is a stored table, which saves a copy.

        The version row publishes the files: they lie under names of their own, so what an
        unfinished run left is never read."""
        if not self.ledger("dataset_versions").filter(F.col("dataset_version") == version).isEmpty():
            raise ValueError(f"Version {version} is already published.")
        snapshot = snapshot if prepared else stored(snapshot, "snapshot")
        path = self.path("parts", f"{version}-{uuid.uuid4().hex}")
        parts = write_parts(self.spark, snapshot, buckets_for(snapshot.count()), path)
        orders = None if unique_orders else snapshot.agg(F.count_distinct("order_id")).first()[0]
        while True:
            number = self.ledger("dataset_versions").count() + 1
            try:
                return self.publish(number, version, parts, quarantine, report, batch_id, at, sample, orders)
            except VersionTaken:
                continue

    def extend_version(self, base: dict, new: DataFrame, version: str, disjoint: bool) -> list[tuple]:
        """Parts of ``base`` with the orders ``new`` added: only what changes is written."""
        path = self.path("parts", f"{version}-{uuid.uuid4().hex}")
        listed = self._listed(base["processed_path"])
        manifest = read_manifest(self.spark, base["processed_path"]) if listed else []
        if not manifest:
            old = None if listed else self.snapshot(base["dataset_version"])
            whole = stored(extended_snapshot(old, new, disjoint=disjoint), "snapshot")
            return write_parts(self.spark, whole, buckets_for(whole.count()), path)
        return extend_parts(self.spark, manifest, new, path, disjoint)

    def publish(
        self, number: int, version: str, parts: list[tuple], quarantine: DataFrame, report: DataFrame,
        batch_id: str, at, sample: bool = False, orders: int | None = None,
    ) -> dict:
        """Enter ``parts`` as the ``number``-th version, or raise VersionTaken. Without ``orders`` there is a row an order."""
        attempt = uuid.uuid4().hex
        paths = {
            "processed_path": self.path("manifests", f"dataset_version={version}", attempt),
            "quarantine_path": self.path("quarantine", f"dataset_version={version}", attempt),
            "report_path": self.path("reports", f"dataset_version={version}", attempt),
        }
        self.spark.createDataFrame(parts, MANIFEST).coalesce(1).write.parquet(paths["processed_path"])
        _write_csv(quarantine, paths["quarantine_path"])
        report.write.json(paths["report_path"])
        rows = sum(p[3] for p in parts)
        size = {"row_count": rows, "order_count": rows if orders is None else orders}
        row = (version, at, batch_id, *size.values(), *paths.values(), sample)
        if not self.commit("dataset_versions", f"{number:010d}", row):
            raise VersionTaken(version)
        return {**size, **paths}

    def log_event(self, event_id: str, at, event_type: str, status: str, message: str, metadata_json: str = "{}") -> None:
        self.append("system_events", [(event_id, at, event_type, status, message, metadata_json)])

    def events(self) -> DataFrame:
        """A repeated event id replaces the earlier row."""
        return latest_per_key(self.ledger("system_events"), ["event_id"], "created_at", "status")

    def predictions(self) -> DataFrame:
        return latest_per_key(self.ledger("predictions"), ["prediction_id"], "predicted_at")


def _write_csv(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """Header CSV with the texts as they are, blanks included."""
    (
        df.write.mode(mode).option("header", True).option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_support_table(df: DataFrame, path: str) -> None:
    """Header CSV, gzipped, one file per task."""
    _write_csv(df, path, "gzip")
