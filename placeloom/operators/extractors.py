"""User extractors as a Python table function: the whole result of each source's pages.

An extractor declares the pages (targets) it reads and turns them into slot rows, each with its evidence, warnings,
and a reason where there are no rows. `run` joins sources laterally with a table function of one call a
source, so that one bad page or function gives an error row and fails no job. The function is polymorphic:
columns of an extractor's own, named with their types in a constant argument, join the rows.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from placeloom.functions.times import SLOTS

CONTRACT = "site_extractor/v1"
#: Columns of the table function; those of an extractor's own come after them.
COLUMNS = [
    StructField(name, kind)
    for name, kind in {
        "record": StringType(), "slot_date": DateType(), "slot": StringType(), "session_no": IntegerType(), "session_label": StringType(), "timezone": StringType(),
        "main_min": IntegerType(), "start_min": IntegerType(), "code": StringType(), "message": StringType(), "target_label": StringType(), "evidence": StringType(),
    }.items()
]


@dataclass(frozen=True)
class Artifact:
    """A stored page of a source, by the label that extractors name it with."""

    label: str
    url: str
    content_type: str | None
    body: str
    artifact_id: str | None


@dataclass(frozen=True)
class Warned:
    code: str
    message: str
    target_label: str | None = None


@dataclass(frozen=True)
class SlotRow:
    """One time of a slot; `more` holds values of the extractor's own columns."""

    slot_date: datetime.date
    slot: str
    main_min: int
    evidence: dict[str, Any]
    start_min: int | None = None
    session_no: int = 1
    session_label: str | None = None
    timezone: str = "Europe/London"
    more: dict[str, Any] = field(default_factory=dict)

    def checked(self, known: set[str]) -> SlotRow:
        """Itself, or an error about what the contract doesn't allow."""
        if not isinstance(self.slot_date, datetime.date) or isinstance(self.slot_date, datetime.datetime):
            raise TypeError(f"slot_date is no date: {self.slot_date!r}")
        if self.slot not in SLOTS:
            raise ValueError(f"unknown slot: {self.slot}")
        for name in ("main_min", "start_min"):
            value = getattr(self, name)
            if (value is not None or name == "main_min") and not (type(value) is int and 0 <= value < 1440):
                raise ValueError(f"{name} is no minute of a day: {value!r}")
        if not self.evidence.get("extractor_key") or not self.evidence.get("target_label"):
            raise ValueError("a row without evidence")
        if unknown := set(self.more) - known:
            raise ValueError(f"columns that weren't declared: {sorted(unknown)}")
        return self


@dataclass(frozen=True)
class Result:
    """What an extractor found: rows and warnings, and why there is no schedule if there are no rows."""

    rows: list[SlotRow] = field(default_factory=list)
    warnings: list[Warned] = field(default_factory=list)
    no_schedule_reason: str | None = None

    def __post_init__(self):
        if not self.rows and not self.no_schedule_reason:
            raise ValueError("no rows and no no_schedule_reason")


@dataclass(frozen=True)
class Context:
    """What an extractor is given: its source and the source's pages by label."""

    source_id: Any
    name: str | None
    url: str | None
    timezone: str
    artifacts: Mapping[str, Artifact]

    def artifact(self, label: str) -> Artifact:
        if label not in self.artifacts:
            raise LookupError(f"target artifact not available: {label}")
        return self.artifacts[label]

    def evidence(self, extractor: Extractor, label: str, **facts: Any) -> dict[str, Any]:
        """Evidence of a row from a page: facts are gate_passed, raw_text, selector, derivation, notes."""
        page = self.artifact(label)
        origin = {"target_label": label, "target_url": page.url, "artifact_id": page.artifact_id, "extractor_key": extractor.key, "extractor_version": extractor.version}
        return {**origin, "contract": CONTRACT, "gate_passed": True, **facts}


class Extractor:
    """Base of user extractors: a key, a version, the labels of its pages, and extract()."""

    key: str = ""
    version: str = ""
    targets: tuple[str, ...] = ()

    def __init__(self):
        if not self.key or not self.version:
            raise ValueError("an extractor has a key and a version")

    def extract(self, found: Context) -> Result:
        raise NotImplementedError


def records(extractor: Extractor | None, found: Context, columns: list[str]) -> Iterator[tuple]:
    """The result of one call as rows of COLUMNS and the extractor's own columns; an error is one row in its place."""
    none, own = (None,) * 7, (None,) * len(columns)
    try:
        if extractor is None:
            raise LookupError("unknown extractor")
        result = extractor.extract(found)
        if not isinstance(result, Result):
            raise TypeError(f"extract() returned {type(result).__name__}")
        rows = [r.checked(set(columns)) for r in result.rows]
        out = [
            ("row", r.slot_date, r.slot, r.session_no, r.session_label, r.timezone, r.main_min, r.start_min, None, None, r.evidence["target_label"], json.dumps(r.evidence, sort_keys=True, ensure_ascii=False), *[r.more.get(c) for c in columns])
            for r in rows
        ]
        out += [("warning", *none, w.code, w.message, w.target_label, None, *own) for w in result.warnings]
        if not rows:
            out.append(("no_schedule", *none, None, result.no_schedule_reason, None, None, *own))
    except Exception as e:  # noqa: BLE001 a user's function may raise anything
        out = [("error", *none, type(e).__name__, str(e), None, None, *own)]
    yield from out


def table_function(extractors: Mapping[str, Extractor]) -> UserDefinedTableFunction:
    """The table function (source struct, artifacts array, extractor, constant columns) over extractors by name."""

    class ExtractorTable:
        @staticmethod
        def analyze(source: AnalyzeArgument, artifacts: AnalyzeArgument, extractor: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
            if not columns.isConstantExpression:
                raise ValueError("the extractors' own columns are a constant: their schema as JSON")
            return AnalyzeResult(schema=StructType([*COLUMNS, *StructType.fromJson(json.loads(columns.value)).fields]))

        def eval(self, source, artifacts, extractor, columns):
            names = StructType.fromJson(json.loads(columns)).names
            chosen = extractors.get(extractor)
            wanted = set(chosen.targets) if chosen is not None else set()
            pages = {a.label: Artifact(a.label, a.url, a.content_type, a.body, a.artifact_id) for a in artifacts or [] if a.label in wanted}
            found = Context(source.source_id, source.name, source.url, source.timezone or "Europe/London", pages)
            yield from records(chosen, found, names)

    return F.udtf(ExtractorTable)


def run(sources: DataFrame, artifacts: DataFrame, extractors: Mapping[str, Extractor], columns: str = "") -> DataFrame:
    """The records of every source (source_id, name, url, timezone, extractor) over its artifacts.

    artifacts: (source_id, label, url, content_type, body, artifact_id), of each source and label the last by
    artifact_id; only labels that an extractor declares are gathered, so a source has at most as many. record is row,
    warning, no_schedule (message is the reason) or error (code and message; nothing else of that source).
    columns: columns of the extractors' own, such as "notes string".
    """
    wanted = sorted({label for e in extractors.values() for label in e.targets})
    latest = artifacts.where(F.col("label").isin(wanted)).groupBy("source_id", "label")
    latest = latest.agg(F.max_by(F.struct("label", "url", "content_type", "body", F.col("artifact_id").cast("string").alias("artifact_id")), "artifact_id").alias("artifact"))
    pages = latest.groupBy("source_id").agg(F.collect_list("artifact").alias("artifacts"))
    given = sources.join(pages, "source_id", "left").select("source_id", F.struct("source_id", "name", "url", "timezone").alias("source"), "artifacts", "extractor")
    outer = [F.col(c).outer() for c in ("source", "artifacts", "extractor")]
    own = StructType.fromDDL(columns) if columns else StructType()
    return given.lateralJoin(table_function(extractors)(*outer, F.lit(own.json()))).drop("source", "artifacts")
