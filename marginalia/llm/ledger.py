"""Duplicates hidden by formatting: canonical keys and an incremental ledger of their counts.

A record's lists are reduced to a key that formatting cannot change. The ledger keeps, in buckets of the
key, one row for each key: how many records have it and which is the earliest of them, and beside it the records seen. Of
a new batch, records seen before are left out; the rest is aggregated by key, then full-outer-joined with those
buckets of the ledger alone that it touches; a bucket of the new version is the join's result, the others are taken
over unread. Records of earlier batches are never read from their source again.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.runtime import scratch

#: Fewest buckets of a ledger; more where the session shuffles into more partitions.
BUCKETS = 16
#: Folders of seen records that a bucket may have before they are written as one, and versions that can still be read.
MOST_FOLDERS, VERSIONS = 8, 2
#: Parts of a canonical key; letters and digits cannot hold them.
ENTRY, FIELD, LIST = "\u001f", "\u001e", "\u001d"


def canonical(entry: Column) -> Column:
    """Letters and digits of ``entry`` in order, ignoring case ('ß' as 'ss'); null for null."""
    folded = F.translate(F.replace(F.lower(entry), F.lit("ß"), F.lit("ss")), "ςſ", "σs")
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")


def canonical_list(entries: Column) -> Column:
    """A list as a multiset of canonical entries; a null entry counts as an entry without letters."""
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.coalesce(canonical(e), F.lit("")))), ENTRY)


def canonical_refs(refs: Column) -> Column:
    """As ``canonical_list``, each entry being the multiset of its fields between ';' and '|'.

    Fields without letters and digits (left by a separator at an end) are no fields.
    """

    def fields(ref: Column) -> Column:
        parts = F.transform(F.split(F.coalesce(ref, F.lit("")), r"[;|]"), canonical)
        return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), FIELD)

    return F.array_join(F.array_sort(F.transform(refs, fields)), ENTRY)


def keyed(df: DataFrame, kind: str, key_col: str, canonical_key: Column, entries: Column, at_col: str | None = None) -> DataFrame:
    """Records as the ledger takes them: (kind, record_key, canon, n_entries), one for each key and canonical form.

    With ``at_col`` the time of arrival stands beside them as ``at``, and a record has a row for every arrival.

    Records with a null key or a null list have no canonical form and are left out. A redelivered
    record with the same content counts once.
    """
    rows = df.select(F.lit(kind).alias("kind"), df[key_col].cast("string").alias("record_key"), F.sha2(canonical_key, 256).alias("canon"), F.size(entries).alias("n_entries"), *([F.col(at_col).cast("timestamp_ntz").alias("at")] if at_col else []))
    rows = rows.where("record_key IS NOT NULL AND canon IS NOT NULL")
    return rows if at_col else rows.distinct()


def knowledge_keys(df: DataFrame, at_col: str | None = None) -> DataFrame:
    """Knowledge objects by their entities; an empty list is not the list of one entry without letters."""
    entities = F.col("entities")
    return keyed(df, "knowledge", "chunk_id", F.when(F.size(entities) == 0, F.lit(LIST)).otherwise(canonical_list(entities)), entities, at_col)


def report_keys(df: DataFrame, at_col: str | None = None) -> DataFrame:
    """Reports by their important entities and references together."""
    both = F.concat(canonical_list(F.col("important_entities")), F.lit(LIST), canonical_refs(F.col("refs")))
    return keyed(df, "report", "report_id", both, F.col("important_entities"), at_col)


def counted(records: DataFrame, least: int = 3) -> DataFrame:
    """The reports and the knowledge objects of at least ``least`` entities among ``records``."""
    return records.where((F.col("kind") != "knowledge") | (F.col("n_entries") >= least))


class Ledger:
    """Counts and earliest records by canonical key, and the records seen, in bucketed files under ``path``.

    Every batch makes a version, whose manifest lists, bucket by bucket, the folders that hold its rows, so a batch reads
    and writes only the buckets of its own keys. A ledger opened on a ``path`` goes on with the latest version there.
    Nothing is overwritten: a reader of the version before and a repeated task are safe, and of two writers of the
    same version the second fails. Files of older versions are removed.
    """

    ROWS = "kind string, canon string, keep_key string, n_copies bigint"
    SEEN = "kind string, canon string, record_key string, n_entries int"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "ledger")
        self.version, self.parts, self.seen_parts = 0, {}, {}
        self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        known = self._manifests()
        if known:
            self.version = max(known)
            state = json.loads(self._read(known[self.version]))
            self.buckets = state["buckets"]
            self.parts, self.seen_parts = ({int(b): x for b, x in state[k].items()} for k in ("rows", "seen"))

    # Manifests are small files, written and read through the file system of ``path``.
    def _file(self, name: str) -> tuple[Any, Any]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _manifests(self) -> dict[int, str]:
        fs, where = self._file("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return {int(n.removesuffix(".json")): f"manifests/{n}" for n in names if n.endswith(".json")}

    def _read(self, name: str) -> str:
        fs, where = self._file(name)
        stream = fs.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _publish(self, rows: dict[int, str], seen: dict[int, list[str]]) -> None:
        text = json.dumps({"buckets": self.buckets, "rows": rows, "seen": seen})
        fs, draft = self._file(f"manifests/{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, final = self._file(f"manifests/{self.version + 1}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has made version {self.version + 1} of {self.path}")
        self.version, self.parts, self.seen_parts = self.version + 1, rows, seen
        self._prune()

    def _prune(self) -> None:
        """Remove the folders that none of the last ``VERSIONS`` versions lists, and older manifests."""
        known = self._manifests()
        kept = sorted(known)[-VERSIONS:]
        states = [json.loads(self._read(known[v])) for v in kept]
        used = {p for s in states for p in [*s["rows"].values(), *(x for xs in s["seen"].values() for x in xs)]}
        for v in known.keys() - set(kept):
            fs, where = self._file(known[v])
            for p in {p for s in [json.loads(self._read(known[v]))] for p in [*s["rows"].values(), *(x for xs in s["seen"].values() for x in xs)]} - used:
                fs.delete(self._file(p)[1], True)
            fs.delete(where, False)

    def _load(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in folders))

    def rows(self, only: set[int] | None = None) -> DataFrame:
        """(kind, canon, keep_key, n_copies) of the present version (of the buckets ``only``)."""
        return self._load(self.ROWS, sorted(p for b, p in self.parts.items() if only is None or b in only))

    def seen(self, only: set[int] | None = None) -> DataFrame:
        """(kind, canon, record_key, n_entries): the records counted so far (in the buckets ``only``)."""
        return self._load(self.SEEN, sorted(p for b, x in self.seen_parts.items() if only is None or b in only for p in x))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("kind", "canon"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _buckets_of(self, folder: str) -> set[int]:
        fs, where = self._file(folder)
        return {int(f.getPath().getName().removeprefix("bucket=")) for f in fs.listStatus(where) if f.getPath().getName().startswith("bucket=")}

    def _write(self, df: DataFrame, folder: str) -> None:
        df.select("*", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def add(self, batch: DataFrame) -> "Ledger":
        """Add records (kind, record_key, canon, n_entries); a record with a canonical key that it has been counted with isn't counted again."""
        if max(self._manifests(), default=0) != self.version:
            raise RuntimeError(f"another writer has gone on from version {self.version} of {self.path}; open it again")
        version = uuid.uuid4().hex
        batch = batch.select("kind", "canon", "record_key", "n_entries").distinct()
        if self.seen_parts:
            batch = batch.join(self.seen().select("kind", "canon", "record_key"), ["kind", "canon", "record_key"], "left_anti")
        self._write(batch, f"{version}/seen")
        touched = self._buckets_of(f"{version}/seen")
        if not touched:
            return self
        seen = self.seen_parts | {b: [*self.seen_parts.get(b, []), f"{version}/seen/bucket={b}"] for b in touched}
        new = self._load(self.SEEN, [f"{version}/seen/bucket={b}" for b in sorted(touched)]).groupBy("kind", "canon").agg(F.min("record_key").alias("new_key"), F.count("*").alias("new_n"))
        merged = self.rows(touched).join(new, ["kind", "canon"], "full_outer").select(
            "kind",
            "canon",
            F.least("keep_key", "new_key").alias("keep_key"),  # least() passes over nulls
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n_copies"),
        )
        self._write(merged, f"{version}/rows")
        full = {b for b, x in seen.items() if len(x) > MOST_FOLDERS}
        if full:
            self._write(self._load(self.SEEN, sorted(p for b in full for p in seen[b])), f"{version}/whole")
            seen |= {b: [f"{version}/whole/bucket={b}"] for b in full}
        self._publish(self.parts | {b: f"{version}/rows/bucket={b}" for b in touched}, seen)
        return self


def arrivals(df: DataFrame, at_col: str) -> list[DataFrame]:
    """``df`` in two batches of arrival, before and from the middle of its time span on; rows that arrived at no known time come last.

    Records delivered again are in both; the ledger counts them once.
    """
    span = df.agg(F.min(at_col).alias("a"), F.max(at_col).alias("b")).first()
    if span["a"] is None:
        return [df]
    middle = F.lit(str(span["a"] + (span["b"] - span["a"]) / 2)).cast(df.schema[at_col].dataType)
    late = F.coalesce(F.col(at_col) >= middle, F.lit(True))
    return [df.where(~late), df.where(late)]


def copies(ledger: Ledger, least: int = 0) -> DataFrame:
    """(kind, keep_key, copy_key) for every record in the ledger that isn't the earliest of its canonical key.

    Knowledge objects count from ``least`` entities on.
    """
    several = ledger.rows().where("n_copies > 1").select("kind", "canon", "keep_key")
    return counted(ledger.seen(), least).join(several, ["kind", "canon"]).where("record_key <> keep_key").select("kind", "keep_key", F.col("record_key").alias("copy_key")).distinct()
