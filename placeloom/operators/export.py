"""Reproducible snapshots: NDJSON, CSV, changes, metadata and a manifest with checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions.times import clock
from placeloom.operators.reads import PUBLIC, latest_version, place_details, public_only, time_order
from placeloom.sources.files import kept

CSV_COLUMNS = ("place_id", "place_name", "date", "slot", "session_no", "session_label", "start_time", "main_time", "timezone", "source_id", "confidence")


def export_places(places: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """Active places with sorted aliases and public sources, in (name, id) order."""
    return place_details(places.where("status = 'active'"), aliases, sources)


def export_occurrences(occurrences: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """Occurrences of active places and public sources."""
    active = places.where("status = 'active'").select("place_id", F.col("name").alias("place_name"))
    return occurrences.join(active, "place_id").join(public_only(sources).select("source_id"), "source_id", "left_semi")


def escaped(json: Column) -> Column:
    r"""JSON with every character above ASCII as \uXXXX (pairs of surrogates above the basic plane)."""
    def code(c: Column) -> Column:
        n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        u = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        above = n - 0x10000
        return F.when(n < 128, c).when(n < 0x10000, u(n)).otherwise(F.concat(u(F.lit(0xD800) + F.shiftright(above, 10)), u(F.lit(0xDC00) + above % 1024)))

    return F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(json, ""), code), "")).otherwise(json)


def as_json(df: DataFrame, kind: str | None = None) -> DataFrame:
    """(value): rows as compact JSON with sorted keys, nulls kept, ASCII only."""
    if kind is not None:
        df = df.withColumn("record_type", F.lit(kind))
    return df.select(escaped(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("value"))


def occurrence_table(occurrences: DataFrame) -> DataFrame:
    """The fixed columns of the CSV."""
    return occurrences.select(
        "place_id", "place_name", F.col("slot_date").cast("string").alias("date"), "slot", "session_no", F.col("label").alias("session_label"),
        clock(F.col("start_min")).alias("start_time"), clock(F.col("main_min")).alias("main_time"), "timezone", "source_id", "confidence",
    )


def write_snapshot(places: DataFrame, occurrences: DataFrame, folder: str) -> None:
    """snapshot.ndjson and occurrences.csv as folders of ordered part files; no single writer.

    The rows are written first: each file reads them twice, for the bounds of its ranges and for its lines.
    """
    places, occurrences = kept(places, "export-places"), kept(occurrences, "export-occurrences")
    ordered = occurrences.repartitionByRange(*time_order()).sortWithinPartitions(*time_order())
    first = places.repartitionByRange("name", "place_id").sortWithinPartitions("name", "place_id")
    as_json(first, "place").unionByName(as_json(occurrence_table(ordered), "occurrence")).write.text(f"{folder}/snapshot.ndjson")
    occurrence_table(ordered).write.csv(f"{folder}/occurrences.csv", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


#: Bytes of a part file that a task holds at a time.
BLOCK = 8 << 20
#: Distinct lines of a leaf of a digest tree, about.
LEAF = 4_096


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of every part file, read back block by block: a part may be of any size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("path", "length")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(name, buffer_size=0) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(sums)], names=["path", "length", "sha256"])

    sums = found.mapInArrow(digests, "path string, length long, sha256 string")
    return sums.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")


def content_digest(lines: DataFrame, digits: int | None = None) -> DataFrame:
    """One row (lines, bytes, sha256) of the lines (value) of a file, in whichever parts and order they lie.

    sha256 is the root of a digest tree: the digests of the distinct lines with their counts, sorted, make leaves by the
    first hex digits (as many as keep a leaf at about LEAF lines), each inner node is the digest of its 16 children's in
    order, and of an empty file that of nothing. No node holds more than a leaf's lines or 16 digests.
    """
    sized = lines.select("value", (F.octet_length("value") + 1).cast("long").alias("bytes"))
    counted = sized.groupBy(F.sha2(F.col("value").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    if digits is None:
        digits = next(d for d in range(16) if counted.count() <= LEAF << 4 * d)
    entry = F.concat("digest", F.lit(":"), F.col("n").cast("string"))
    nodes = counted.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ",").cast("binary"), 256).alias("sha256"), F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"))
    for d in range(digits - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "sha256"))), lambda x: F.concat(x["prefix"], F.lit(":"), x["sha256"])), ",")
        nodes = nodes.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(children.cast("binary"), 256).alias("sha256"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    total = nodes.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.max("sha256").alias("sha256"))
    return total.select(F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def snapshot_digests(spark: SparkSession, folder: str, digits: int | None = None) -> DataFrame:
    """(file, lines, bytes, sha256) of the files of a written snapshot, read back; the CSV's header of each part isn't counted."""
    snapshot = spark.read.text(f"{folder}/snapshot.ndjson")
    table = spark.read.text(f"{folder}/occurrences.csv").where(~F.col("value").startswith("place_id,"))
    parts = [content_digest(lines, digits).withColumn("file", F.lit(name)) for name, lines in (("snapshot.ndjson", snapshot), ("occurrences.csv", table))]
    return parts[0].unionByName(parts[1]).select("file", "lines", "bytes", "sha256")


def version_to_export(versions: DataFrame, version: str | None = None) -> DataFrame:
    """The one version to export (the latest published if none is named); an error if it isn't there or isn't published."""
    found = latest_version(versions, version)
    rows = found.select("version", "status").collect()  # one row at most
    if not rows:
        raise ValueError("dataset version not found")
    if rows[0].status != "published":
        raise ValueError("dataset version is not published")
    return found


def metadata(places: DataFrame, occurrences: DataFrame, sources: DataFrame, default: str) -> DataFrame:
    """One row: counts, and the attribution: the default line, then distinct ones of public sources by first source."""
    used = sources.join(places.where("status = 'active'").select("place_id"), "place_id", "left_semi")
    counts = used.agg(F.count_if(F.col("policy") == PUBLIC).alias("public_sources"), F.count_if(F.col("policy") != PUBLIC).alias("restricted_sources"))
    lines = public_only(used).select(F.nullif(F.trim("attribution"), F.lit("")).alias("line"), "source_id").where("line is not null")
    lines = lines.groupBy("line").agg(F.min("source_id").alias("first"))
    text = lines.agg(F.array_join(F.concat(F.array(F.lit(default)), F.transform(F.array_sort(F.collect_list(F.struct("first", "line"))), lambda x: x["line"])), "\n").alias("attribution"))
    shown = places.agg(F.count_if(F.col("status") == "active").alias("places"))
    rows = occurrences.agg(F.count(F.lit(1)).alias("occurrences"))
    return shown.select("*", rows.scalar().alias("occurrences"), *[counts.select(c).scalar().alias(c) for c in counts.columns], text.scalar().alias("attribution"))
