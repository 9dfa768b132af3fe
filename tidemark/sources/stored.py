"""Stored tables in parts and versions: hash buckets of a key, or days.

A version is a manifest that names the folder of every part.  A write puts the parts that change
into a new folder and then names them in the next manifest, which is renamed into place in one
step: readers see the old version or the new one, a write that fails leaves the old one as it
was, and of two writers the second is refused.  Parts that do not change are not touched.

Null part values are a part of their own.  The driver handles a manifest of one line a part, so
the number of parts, not of rows, is what it must hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import merged
from tidemark.sources import folders

_PART = "__part"


class Conflict(RuntimeError):
    """Another writer made the next version first; read again and retry."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType | None
    parts: dict[int | None, str]
    tags: dict[str, int]


def buckets(key: Iterable[str], n: int) -> str:
    """The part expression of ``n`` hash buckets of a key."""
    return f"pmod(xxhash64({', '.join(f'`{k}`' for k in key)}), {n})"


def days(ts: str) -> str:
    """The part expression of whole UTC days of seconds."""
    return f"floor(`{ts}` / 86400)"


@dataclass(frozen=True)
class StoredTable:
    """The table below ``path``; ``part`` is the SQL expression that deals its rows into parts."""

    spark: SparkSession
    path: str
    part: str

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in folders.names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0].isdigit())

    def version(self, number: int | None = None) -> Version:
        known = self.versions()
        if number is None and not known:
            return Version(0, None, {}, {})
        number = known[-1] if number is None else number
        said = json.loads(self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0])
        parts = {None if k == "null" else int(k): v for k, v in said["parts"].items()}
        return Version(number, T.StructType.fromJson(said["schema"]) if said["schema"] else None, parts, said["tags"])

    def _read(self, version: Version, wanted: Iterable[int | None]) -> DataFrame | None:
        if version.schema is None:
            return None
        at = [f"{self.path}/data/{version.parts[p]}" for p in wanted]
        return self.spark.read.schema(version.schema).parquet(*at) if at else self.spark.createDataFrame([], version.schema)

    def read(self, number: int | None = None, least: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless told; with ``least`` those of parts from it on."""
        version = self.version(number)
        wanted = [p for p in version.parts if least is None or (p is not None and p >= least)]
        out = self._read(version, wanted)
        if out is None:
            raise ValueError(f"{self.path} has no version")
        return out

    def _commit(self, old: Version, schema: T.StructType | None, rows: DataFrame | None, gone: Iterable[int | None], tag: tuple[str, int] | None) -> Version:
        parts = {p: f for p, f in old.parts.items() if p not in set(gone)}
        if rows is not None:
            run = uuid.uuid4().hex
            at = f"{self.path}/data/{run}"
            rows.withColumn(_PART, F.expr(self.part).cast("long")).repartition(_PART).write.partitionBy(_PART).parquet(at)
            for name in folders.names(self.spark, at):
                if name.startswith(f"{_PART}="):
                    value = name.removeprefix(f"{_PART}=")
                    parts[None if value == "__HIVE_DEFAULT_PARTITION__" else int(value)] = f"{run}/{name}"
        tags = old.tags | ({tag[0]: tag[1]} if tag else {})
        said = {"schema": schema.jsonValue() if schema else None, "parts": {"null" if p is None else str(p): f for p, f in parts.items()}, "tags": tags}
        aside = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        folders.put_text(self.spark, aside, json.dumps(said))
        if not folders.renamed(self.spark, aside, f"{self.path}/manifests/{old.number + 1}.json"):
            folders.removed(self.spark, aside)
            raise Conflict(f"version {old.number + 1} of {self.path} is another writer's")
        return Version(old.number + 1, schema, parts, tags)

    def _touched(self, rows: DataFrame) -> list[int | None]:
        return [r[0] for r in rows.select(F.expr(self.part).cast("long").alias(_PART)).distinct().collect()]  # a row a part

    def applied(self, tag: tuple[str, int] | None, version: Version) -> bool:
        return tag is not None and version.tags.get(tag[0], -1) >= tag[1]

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], tag: tuple[str, int] | None = None) -> Version:
        """Merges rows into the parts that they fall into.

        ``merge`` takes the old and new rows of those parts, ``__new`` telling them apart, and
        gives the rows to keep; a row's part must follow from its key.  A tag (name, number)
        that was applied already, as by a batch that a stream sends again, changes nothing.
        """
        old = self.version()
        if self.applied(tag, old):
            return old
        touched = self._touched(rows)
        before = self._read(old, [p for p in touched if p in old.parts])
        both = rows.withColumn("__new", F.lit(True))
        if before is not None:
            both = before.withColumn("__new", F.lit(False)).unionByName(both, allowMissingColumns=True)
        return self._commit(old, old.schema or rows.schema, merge(both).select(*(old.schema or rows.schema).names), touched, tag)

    def replace(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> tuple[Version, list[int | None]]:
        """Makes the table equal to ``rows``: rows that are missing there go.  Only parts whose
        rows differ are written; they are returned beside the version."""
        old = self.version()
        if self.applied(tag, old):
            return old, []
        new = self._digests(rows)
        before = self._read(old, old.parts) if old.schema is not None and old.schema.names == rows.schema.names else None
        known = self._digests(before) if before is not None else {}
        changed = [p for p in new if new[p] != known.get(p)]
        gone = [*changed, *[p for p in old.parts if p not in new]]
        part = F.expr(self.part).cast("long")
        null = part.isNull() if None in changed else F.lit(False)
        some = rows.where(part.isin(*[p for p in changed if p is not None]) | null) if changed else None
        return self._commit(old, rows.schema, some, gone, tag), gone

    def put(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> Version:
        """Takes rows in place of all that is in the parts they fall into."""
        return self.upsert(rows, lambda both: both.where("__new"), tag)

    def append(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> Version:
        return self.upsert(rows, lambda both: both, tag)

    def _digests(self, rows: DataFrame) -> dict[int | None, tuple]:
        """Per part the number of its rows and two sums of their hashes, whatever their order."""
        shown = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        hashed = rows.select(F.expr(self.part).cast("long").alias(_PART), F.xxhash64(shown).alias("h"), F.xxhash64(F.lit("two"), shown).alias("g"))
        sums = hashed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
        return {r[_PART]: (r["n"], r["h"], r["g"]) for r in sums.collect()}  # a row a part

    def delete(self, where: Callable[[DataFrame], DataFrame], parts: Iterable[int | None] | None = None, tag: tuple[str, int] | None = None) -> Version:
        """Keeps what ``where`` keeps of the named parts, or of all."""
        old = self.version()
        wanted = [p for p in old.parts if parts is None or p in set(parts)]
        if self.applied(tag, old) or not wanted:
            return old
        return self._commit(old, old.schema, where(self._read(old, wanted)), wanted, tag)

    def drop(self, parts: Iterable[int | None]) -> Version:
        """Forgets whole parts: a new manifest, no row is read."""
        old = self.version()
        gone = [p for p in parts if p in old.parts]
        return self._commit(old, old.schema, None, gone, None) if gone else old

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes folders that none of the last ``keep`` versions names, and older manifests;
        only while nobody writes, because a write's folder is named at its end."""
        last = self.versions()[-keep:]
        named = {f.split("/")[0] for n in last for f in self.version(n).parts.values()}
        for n in set(self.versions()) - set(last):
            folders.removed(self.spark, f"{self.path}/manifests/{n}.json")
        gone = [n for n in folders.names(self.spark, f"{self.path}/data") if n not in named]
        for name in gone:
            folders.removed(self.spark, f"{self.path}/data/{name}")
        return gone


def newest_by(key: list[str], *seen: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps one whole row of a key: of the new rows, else the old, the one that
    was seen last."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct("__new", *seen)).alias("__r")).select("__r.*")

    return merge


def merged_by(key: list[str], rules: dict[str, str], *seen: str) -> Callable[[DataFrame], DataFrame]:
    """A merge by column rules: what arrives now counts as later than what is there."""
    def merge(rows: DataFrame) -> DataFrame:
        return merged(rows.withColumn("__at", F.struct("__new", *seen)), key, "__at", rules)

    return merge
