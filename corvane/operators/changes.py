"""Work on new or changed records only: what is due, and a ledger that survives failures (problem 4).

The ledger is a log of commits. Each commit holds events of work items and gets the next free number by a claim that
only one of several writers wins; the others look at the state again before they try the next number. An item's state
is folded from its events: pending, leased or done; a lease that has expired counts as pending. The number of the
commit that leases an item is the lease's fencing token, so tokens only grow and no two leases share one. A writer
whose lease was given to another is refused when it finishes. Events and results lie under paths made of the commit's
number and of the token, so a retried job writes the same files again; what no commit names is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import storage

EVENTS = "item string, version string, kind string, token long, owner string, until long"


def latest(df: DataFrame, key: str | tuple[str, ...], *order: str) -> DataFrame:
    """The row of each key with the greatest `order`; of equal rows one, of others that tie the greatest in all columns.

    Rows whose order columns are null come last. One aggregation with partial results, so of a key that holds a third
    of all rows each task sends on one row. (Spark aggregates structs with strings by sorting each task's rows, not by hash.)
    """
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[F.col(c) for c in (*order, *rest)])
    keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate((key,) if isinstance(key, str) else key)]
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select("_row.*").select(*df.columns)


def _hex(c: Column) -> Column:
    return F.lower(c)


def fold(events: DataFrame, now: int) -> DataFrame:
    """(item, version, state, token, owner, until, offered, behind): each version of an item as its events leave it at `now`.

    Done counts only from the holder of the last lease; a lease that has expired leaves the item pending. A version
    offered before the item's last one (`behind`) is superseded unless it is done; a version never offered is no work. One
    aggregation with partial results; an item with very many events costs no more than others.
    """
    done = F.max(F.when(F.col("kind") == "done", F.col("token")))
    lease = F.max(F.when(F.col("kind") == "leased", F.struct("token", "until", "owner")))
    offered = F.max(F.when(F.col("kind") == "pending", F.col("token")))
    folded = events.groupBy("item", "version").agg(done.alias("done"), lease.alias("lease"), offered.alias("offered"))
    last = F.max("offered").over(Window.partitionBy("item"))
    state = (
        F.when(F.col("done") == F.col("lease.token"), "done").when(F.col("offered").isNull() | (F.col("offered") < last), "superseded")
        .when(F.col("lease.until") > now, "leased").otherwise("pending")
    )
    return folded.select("item", "version", state.alias("state"), F.coalesce("lease.token", F.lit(0)).alias("token"), F.col("lease.owner").alias("owner"), F.col("lease.until").alias("until"), "offered", (last.isNotNull() & (F.coalesce("offered", F.lit(0)) < last)).alias("behind"))


def _version(size: str, mtime: str, revision: str, signature: Column) -> Column:
    """What a file must be read again for; '?' stands for a null part, and such a version is never taken from a manifest as done."""
    parts = F.col(size).cast("string"), F.col(mtime).cast("string"), _hex(F.col(revision)), _hex(signature)
    return F.concat_ws("|", *[F.coalesce(p, F.lit("?")) for p in parts])


def manifest_events(states: DataFrame) -> DataFrame:
    """The ledger's events that a manifest's current rows stand for.

    An indexed row whose indexed_revision equals its revision was leased and done, by the build it names; one left
    extracting was leased by a build that is over, so its lease has expired. Others left nothing behind.
    """
    indexed = (F.col("status") == "indexed") & (_hex(F.col("indexed_revision")) == _hex(F.col("revision"))) & F.col("size").isNotNull() & F.col("mtime_ns").isNotNull() & F.col("index_signature").isNotNull()
    kinds = F.when(indexed, F.array(F.lit("leased"), F.lit("done"))).when(F.col("status") == "extracting", F.array(F.lit("leased")))
    owner = F.col("build_id") if "build_id" in states.columns else F.lit(None).cast("string")
    return states.select(
        F.col("document_id").alias("item"), _version("size", "mtime_ns", "revision", F.col("index_signature")).alias("version"), F.explode(kinds).alias("kind"),
        F.lit(0).cast("long").alias("token"), owner.alias("owner"), F.lit(0).cast("long").alias("until"),
    )


def offers(scan: DataFrame, builds: DataFrame) -> DataFrame:
    """The current rows of a scan's files with the version (`_version`) that the due build must bring them to.

    The due build is the one with the greatest started_at; of several of that time the one with the greatest signature.
    """
    files = latest(scan.where("document_id is not null"), "document_id", "seen_at")
    signature = builds.agg(F.max(F.struct(F.col("started_at"), F.col("index_signature"))).alias("b")).select(F.col("b.index_signature").alias("_signature"), F.lit(1).alias("_one"))
    known = files.withColumn("_one", F.lit(1)).join(F.broadcast(signature), "_one")  # one row
    return known.withColumn("_version", _version("size", "mtime_ns", "revision", F.col("_signature"))).select(*scan.columns, "_version")


def due(ledger: Ledger, scan: DataFrame, manifest: DataFrame, builds: DataFrame, owner: str = "build", now: int = 1, seconds: int = 3600) -> DataFrame:
    """The current rows of files that the due build must read: the work items that the ledger leases to it.

    The manifest's current rows enter an empty ledger as events; the scan's files are offered in the version the build
    must bring them to, and what is then pending is leased. A file is up to date only if its version is done. A null
    in any part, a missing state or no build at all makes a file due, so nothing is left out. Hex is compared without
    regard to case. Of rows with equal times the one with the greatest columns counts.
    """
    if not ledger.commits():
        ledger.adopt(manifest_events(latest(manifest.where("document_id is not null"), "document_id", "updated_at")))
    files = offers(scan, builds)
    ledger.offer(files.select(F.col("document_id").alias("item"), F.col("_version").alias("version")), now)
    mine = ledger.lease(owner, now, seconds)
    return files.join(mine.select(F.col("item").alias("document_id"), F.col("version").alias("_version")), ["document_id", "_version"], "left_semi").select(*scan.columns)


#: Commits after which the next one writes the whole state, so that readers need no older events.
COMPACTED = 20


@dataclass(frozen=True)
class Ledger:
    """Work items in a folder that all executors share. `path` holds log/, events/ and results/."""

    spark: SparkSession
    path: str

    def commits(self) -> list[int]:
        return [int(n) for n in storage.names(self.spark, f"{self.path}/log") if n.isdigit()]

    def _since(self) -> tuple[list[int], list[str], int]:
        """All commits, the folders whose events make up the present state, and how many they are."""
        numbers, folders = self.commits(), []
        for n in reversed(numbers):
            entry = json.loads(storage.read(self.spark, f"{self.path}/log/{n:010d}") or "{}")
            folders.append(f"{self.path}/events/{entry['events']}")
            if entry["whole"]:
                break
        return numbers, folders, len(folders)

    def events(self) -> DataFrame:
        _, folders, n = self._since()
        return self.spark.read.schema(EVENTS).parquet(*folders) if n else self.spark.createDataFrame([], EVENTS)

    def states(self, now: int) -> DataFrame:
        """(item, version, state, token, owner, until, offered, behind): each version of an item as it stands at `now`."""
        return fold(self.events(), now)

    def _commit(self, events: Callable[[DataFrame, int], DataFrame], now: int) -> int:
        """Writes what `events` makes of the present states and the commit's number; again if another commit came first."""
        while True:
            numbers, _, behind = self._since()
            number, whole = (numbers[-1] if numbers else 0) + 1, behind >= COMPACTED
            new = events(self.states(now), number).select(*[c.split()[0] for c in EVENTS.split(", ")])
            if whole:
                new = new.unionByName(_events_of(self.states(now)))
            name = f"{number:010d}-{uuid.uuid4().hex}"
            new.write.mode("overwrite").parquet(f"{self.path}/events/{name}")
            if storage.claim(self.spark, f"{self.path}/log/{number:010d}", json.dumps({"events": name, "whole": whole})):
                return number
            storage.remove(self.spark, f"{self.path}/events/{name}")

    def adopt(self, events: DataFrame) -> None:
        """Takes over what is known from elsewhere: (item, version, kind, token, owner, until)."""
        self._commit(lambda _, number: events, 0)

    def offer(self, items: DataFrame, now: int) -> None:
        """Adds (item, version) pairs as pending; those done, leased or pending stay as they are. Other versions of the items are superseded."""
        asked = items.select("item", "version").where("item is not null and version is not null").distinct()
        self._commit(lambda states, number: asked.join(states.where("state <> 'superseded' and not behind"), ["item", "version"], "left_anti").select("*", *_event("pending", F.lit(number))), now)

    def lease(self, owner: str, now: int, seconds: int, limit: int | None = None) -> DataFrame:
        """Leases pending items, in the order of their names, and returns (item, version, token). No two leases share items or tokens."""

        def free(states: DataFrame, number: int) -> DataFrame:
            rows = states.where("state = 'pending'")
            if limit is not None:
                rows = rows.orderBy("item", "version").limit(limit)
            return rows.select("item", "version", *_event("leased", F.lit(number), F.lit(owner), F.lit(now + seconds)))

        token = self._commit(free, now)
        entry = json.loads(storage.read(self.spark, f"{self.path}/log/{token:010d}") or "{}")
        mine = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events/{entry['events']}")
        return mine.where((F.col("kind") == "leased") & (F.col("token") == token)).select("item", "version", "token")

    def finish(self, results: DataFrame, token: int, owner: str, now: int, part: str = "0") -> DataFrame:
        """Writes the results (item, version, …) of a lease, marks them done and returns the (item, version) that were refused.

        Results lie under the token and `part`, so a repetition writes the same files again. Refused is what the
        token's owner doesn't hold any more; what it has finished before is neither refused nor marked again. A failure
        before the mark leaves the items leased, and their results are read by nobody.
        """
        folder = f"{self.path}/results/token={token}/part={part}"
        results.drop("token").write.mode("overwrite").parquet(folder)
        asked = self.spark.read.parquet(folder).select("item", "version").distinct()
        mine = (F.col("token") == token) & (F.col("owner") == owner)
        self._commit(lambda states, _: asked.join(states.where((F.col("state") == "leased") & mine), ["item", "version"], "left_semi").select("*", *_event("done", F.lit(token), F.lit(owner))), now)
        return asked.join(self.states(now).where((F.col("state") == "done") & mine), ["item", "version"], "left_anti")

    def results(self, now: int) -> DataFrame:
        """All rows of each done item's result, from the holder of its last lease."""
        rows = self.spark.read.option("basePath", f"{self.path}/results").parquet(f"{self.path}/results").drop("part").withColumn("token", F.col("token").cast("long"))
        return rows.join(self.states(now).where("state = 'done'").select("item", "version", "token"), ["item", "version", "token"], "left_semi")


def _event(kind: str, token: Column, owner: Column | None = None, until: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [F.lit(kind).alias("kind"), token.cast("long").alias("token"), (none if owner is None else owner).cast("string").alias("owner"), (none if until is None else until).cast("long").alias("until")]


def _events_of(states: DataFrame) -> DataFrame:
    """The fewest events that fold to the same states."""
    kinds = F.array_compact(F.array(
        F.when(F.col("offered").isNotNull(), F.struct(*_event("pending", F.col("offered")))),
        F.when(F.col("token").isNotNull() & F.col("until").isNotNull(), F.struct(*_event("leased", F.col("token"), F.col("owner"), F.col("until")))),
        F.when(F.col("state") == "done", F.struct(*_event("done", F.col("token"), F.col("owner")))),
    ))
    return states.select("item", "version", F.explode(kinds).alias("e")).select("item", "version", "e.*")
