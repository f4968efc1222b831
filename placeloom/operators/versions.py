"""Published versions in a folder, with a commit protocol: the sink of publish.publish.

A version's rows lie in buckets by place. A publication writes the buckets that differ from those of the version
it starts from (the others are named again), then its change events, then a manifest that lists all of it, and at
last the next numbered entry of the log, which only one writer can create. The highest entry is the current version:
readers go through it alone, so they see a whole version or the one before, whatever a writer was doing when it
stopped. A writer whose entry is taken already works its result out again from the version that took it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators import publish
from placeloom.sources import files

#: Buckets of the rows; a publication rewrites at least one of them.
BUCKETS = 64
ROWS = {"place_id": "long", "slot_date": "date", "slot": "string", "session_no": "int", "candidate_id": "long", "main_min": "int", "start_min": "int", "label": "string", "timezone": "string", "source_id": "long", "confidence": "string"}
EVENTS = {"event_id": "long", "kind": "string", "place_id": "long", "payload": "string"}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


class Conflict(Exception):
    """Another writer has published since the version that a publication started from."""


@dataclass(frozen=True)
class Bucket:
    """Where a bucket's rows are, and the count and digest that tell whether they changed."""

    path: str
    rows: int
    digest: str


@dataclass(frozen=True)
class Version:
    """What a manifest says. name is day.N, the Nth version of a day; names has the last N of each day."""

    number: int
    name: str
    names: dict[str, int]
    buckets: dict[str, Bucket] = field(default_factory=dict)
    events: str | None = None
    first_event_id: int = 0
    last_event_id: int = 0

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.buckets.values())

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Version:
        got = json.loads(text)
        return Version(**{**got, "buckets": {k: Bucket(**b) for k, b in got["buckets"].items()}})


class VersionedTable:
    """The versions below a folder that all executors and writers share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _entry(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def numbers(self) -> list[int]:
        """Numbers of the committed versions."""
        return [int(n[:-5]) for n in files.names_in(self.spark, f"{self.root}/log") if n[:-5].isdigit() and n.endswith(".json")]

    def version(self, number: int) -> Version:
        manifest = json.loads(files.read_text(self.spark, self._entry(number)))["manifest"]
        return Version.from_json(files.read_text(self.spark, f"{self.root}/{manifest}"))

    def current(self) -> Version | None:
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def rows(self, version: Version | None = None) -> DataFrame:
        """Rows of a version, by default the current one; none if nothing is published."""
        version = version or self.current()
        if version is None or not version.buckets:
            return self.spark.createDataFrame([], _ddl(ROWS))
        return self.spark.read.schema(_ddl(ROWS)).parquet(*[f"{self.root}/{b.path}" for b in version.buckets.values()])

    def events(self, after: int = 0) -> DataFrame:
        """Change events of all committed versions with ids above `after`."""
        found = [v for v in map(self.version, self.numbers()) if v.events and v.last_event_id > after]
        if not found:
            return self.spark.createDataFrame([], _ddl(EVENTS))
        return self.spark.read.schema(_ddl(EVENTS)).parquet(*[f"{self.root}/{v.events}" for v in found]).where(F.col("event_id") > after)

    def stage(self, result: DataFrame, base: Version | None, day: str) -> Version:
        """Write what publish.publish made of the base's rows; nothing points to it yet."""
        token = uuid.uuid4().hex
        # used three times, and the next version's files must not depend on the last one's being read again
        draft = f"{self.root}/drafts/{token}"
        result.withColumns({c: F.col(c).cast(kind) for c, kind in ROWS.items()}).write.parquet(draft)
        result = self.spark.read.parquet(draft)
        bucket = F.pmod(F.xxhash64("place_id"), F.lit(self.buckets)).cast("int")
        kept = result.where(F.col("action") != "removed").select(*ROWS, bucket.alias("bucket"))
        digest = F.sum(F.xxhash64(*ROWS).cast("decimal(38,0)")).cast("string")
        now = {str(r.bucket): Bucket(f"data/{token}/bucket={r.bucket}", r.n, r.digest) for r in kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")).collect()}
        before = base.buckets if base else {}
        same = {k for k, b in now.items() if k in before and (b.rows, b.digest) == (before[k].rows, before[k].digest)}
        fresh = kept.where(~F.col("bucket").isin([int(k) for k in same])) if same else kept
        if len(same) < len(now):
            # ranges, not hashes: a bucket is as many files as its size asks for, each of neighbouring places
            fresh.repartitionByRange("bucket", "place_id", "slot_date").write.partitionBy("bucket").parquet(f"{self.root}/data/{token}")
        last = base.last_event_id if base else 0
        publish.events(result, last).select(*[F.col(c).cast(kind) for c, kind in EVENTS.items()]).write.parquet(f"{self.root}/events/{token}")
        events = self.spark.read.schema(_ddl(EVENTS)).parquet(f"{self.root}/events/{token}").count()
        files.delete_folder(self.spark, draft)
        names = dict(base.names) if base else {}
        names[day] = names.get(day, 0) + 1
        buckets = {k: before[k] if k in same else b for k, b in now.items()}
        return Version((base.number if base else 0) + 1, f"{day}.{names[day]}", names, buckets, f"events/{token}" if events else None, last + 1, last + events)

    def commit(self, version: Version) -> None:
        """Write the manifest, then the log entry; Conflict if another writer has that number, and so that name."""
        manifest = f"manifests/{uuid.uuid4().hex}.json"
        files.write_text(self.spark, f"{self.root}/{manifest}", version.to_json())
        if not files.create_once(self.spark, self._entry(version.number), json.dumps({"manifest": manifest, "name": version.name})):
            raise Conflict(f"version {version.number} is published already")

    def publish(self, make: Callable[[DataFrame], DataFrame], day: str, attempts: int = 8) -> Version:
        """Publish make(rows of the current version), a result of publish.publish, as the next version.

        If another writer is first, make is called again with that one's rows: no publication is lost or
        half seen, and a name is given once.
        """
        for _ in range(attempts):
            base = self.current()
            version = self.stage(make(self.rows(base)), base, day)
            try:
                self.commit(version)
            except Conflict:
                continue
            return version
        raise Conflict(f"{attempts} attempts, and each time another writer was first")

    def vacuum(self, hours: float = 24) -> list[str]:
        """Delete what no committed version names and is older than `hours` (that of stopped or beaten writers); its paths.

        Writers must not take longer than `hours`.
        """
        used = set()
        for number in self.numbers():
            v = self.version(number)
            used |= {b.path.split("/")[1] for b in v.buckets.values()} | ({v.events.split("/")[1]} if v.events else set())
        lost = [f"{self.root}/{kind}/{token}" for kind in ("data", "events", "drafts") for token in files.names_in(self.spark, f"{self.root}/{kind}") if token not in used]
        lost = [p for p in lost if files.age_hours(self.spark, p) >= hours]
        for path in lost:
            files.delete_folder(self.spark, path)
        return lost
