"""Page to timetable rows: declarative tables, embedded JSON, candidates. User extractors: extractors.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions.html import parsed_tables
from placeloom.functions.times import afternoon_where_due, british_date, day_of_month, in_window, minutes_loose, minutes_of, plus_minutes


def find_table(tables: Column, keywords: list[str]) -> Column:
    """The first table whose header row holds every keyword."""
    header = lambda t: F.lower(F.array_join(F.get(t, F.lit(0)), " "))
    fits = lambda t: F.forall(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(header(t), k))
    return F.get(F.filter(tables, fits), F.lit(0))


# Cells that repeat the one above.
DITTO = ("", '"', "''", "-do-", "ditto")


def carried(cell: Column, down: Window) -> Column:
    """The cell, or the last one above it in the window where it is blank or a ditto mark."""
    own = F.when(~F.lower(F.trim(cell)).isin(*DITTO), cell)
    return F.last(own, ignorenulls=True).over(down)


def column_index(header: Column, spec: str | int) -> Column:
    """Index of a column by number, or of the first header cell that holds a text; null if there is none."""
    if isinstance(spec, int):
        return F.lit(spec)
    found = F.array_position(F.transform(header, lambda c: F.contains(F.lower(c), F.lit(spec.lower()))), True)
    return F.when(found > 0, found - 1).cast("int")


def table_rows(
    pages: DataFrame, keywords: list[str], date_column: str | int, slot_columns: dict[str, str | int], year: int,
    month: int | None = None, start_columns: dict[str, str | int] | None = None, carry_forward: bool = False,
) -> DataFrame:
    """Slot rows (page_id, row, slot_date, slot, main_min, start_min, warning) of the first fitting table of each page.

    Columns are named by a part of their header or by index. Only the parse into cells is Python. A row has
    a time or a warning: no_table and no_date_column once a page, missing_prayer_column once a page and
    slot; unparseable_time and implausible_time at a cell. Rows without a date and blank cells give nothing.
    A bare day of the month counts if `month` is given. carry_forward fills blank and ditto cells, the date's too.
    """
    starts = start_columns or {}
    table = pages.select("page_id", find_table(parsed_tables(F.col("html")), keywords).alias("table"))
    header = F.get("table", F.lit(0))
    index = {s: column_index(header, c) for s, c in slot_columns.items()}
    start_index = {s: column_index(header, starts[s]) if s in starts else F.lit(None).cast("int") for s in slot_columns}
    places = F.array(*[F.struct(F.lit(s).alias("slot"), index[s].alias("at"), start_index[s].alias("start_at")) for s in slot_columns])
    found = table.select("page_id", "table", column_index(header, date_column).alias("date_at"), places.alias("places"))

    # cells and warnings of a page are one array, so that no page is parsed or grouped again for each kind of warning
    text = F.lit(None).cast("string")

    def entry(row: Column, day: Column, slot: Column, cell: Column, start: Column, warning: Column) -> Column:
        fields = {"row": row.cast("int"), "day": day, "slot": slot, "cell": cell, "start": start, "found": warning}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    warned = lambda slot, code: entry(F.lit(None), text, slot, text, text, F.lit(code))
    missing = F.transform(F.filter("places", lambda p: p["at"].isNull()), lambda p: warned(p["slot"], "missing_prayer_column"))
    there = F.filter("places", lambda p: p["at"].isNotNull())
    body = F.slice("table", F.lit(2), F.greatest(F.size("table") - 1, F.lit(0)))
    cells = F.transform(body, lambda c, i: F.transform(there, lambda p: entry(i + 1, F.get(c, F.col("date_at")), p["slot"], F.get(c, p["at"]), F.get(c, p["start_at"]), text)))
    entries = (
        F.when(F.col("table").isNull(), F.array(warned(text, "no_table"))).when(F.col("date_at").isNull(), F.array(warned(text, "no_date_column")))
        .otherwise(F.concat(missing, F.flatten(cells)))
    )
    rows = found.select("page_id", F.inline(entries))
    if carry_forward:
        down = Window.partitionBy("page_id", "slot").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({c: carried(F.coalesce(c, F.lit("")), down) for c in ("day", "cell", "start")})
    date = british_date(F.col("day"), year)
    if month is not None:
        date = F.coalesce(date, F.try_to_date(F.concat_ws("-", F.lit(f"{year}-{month:02d}"), F.lpad(day_of_month(F.col("day")).cast("string"), 2, "0"))))
    read = lambda c: afternoon_where_due(minutes_loose(F.col(c)), F.col("slot"))
    shown = F.coalesce(F.trim("cell"), F.lit("")) != ""
    parsed = F.struct(date.alias("slot_date"), read("cell").alias("time"), read("start").alias("start_min"))
    # filtered as an array: a filter of rows would be pushed below and work the dates out twice
    kept = F.filter(F.array(parsed), lambda x: F.col("found").isNotNull() | (x["slot_date"].isNotNull() & shown))
    rows = rows.select("page_id", "row", "slot", "found", F.inline(kept))
    warning = F.when(F.col("time").isNull(), "unparseable_time").when(~in_window(F.col("time"), F.col("slot")), "implausible_time")
    rows = rows.withColumn("warning", F.coalesce("found", warning))
    good = lambda c: F.when(F.col("warning").isNull(), F.col(c)).alias(c)
    dated = F.when(F.col("found").isNull(), F.col("slot_date")).alias("slot_date")
    return rows.select("page_id", "row", dated, "slot", good("time").alias("main_min"), good("start_min"), "warning")


def state_rows(pages: DataFrame) -> DataFrame:
    """Slot rows from percent-decoded JSON in `window.REDUX_STATE = "..."`: times of `timetable[].iqamah`, jumuah a list of sessions."""
    raw = F.regexp_extract("html", r'window\.REDUX_STATE\s*=\s*"([^"]*)"', 1)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    shape = "struct<timetable:array<struct<date:string,iqamah:struct<fajr:string,dhuhr:string,asr:string,maghrib:string,isha:string,jumuah:array<string>>>>>"
    days = pages.select("page_id", F.inline(F.from_json(decoded, shape)["timetable"]))
    daily = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(1).alias("session_no"), F.col(f"iqamah.{s}").alias("time")) for s in ("fajr", "dhuhr", "asr", "maghrib", "isha")])
    friday = F.transform(F.coalesce("iqamah.jumuah", F.array().cast("array<string>")), lambda t, i: F.struct(F.lit("jumuah").alias("slot"), (i + 1).alias("session_no"), t.alias("time")))
    rows = days.select("page_id", F.try_to_date(F.substring("date", 1, 10)).alias("slot_date"), F.inline(F.concat(daily, friday)))
    minutes = minutes_of(F.substring("time", 12, 5))
    kept = rows.select("page_id", "slot_date", "slot", "session_no", minutes.alias("main_min"))
    return kept.where(F.col("main_min").isNotNull() & ((F.col("slot") == "jumuah") | in_window(F.col("main_min"), F.col("slot"))))


def calendar_rows(pages: DataFrame, year: int) -> DataFrame:
    """Slot rows (page_id, slot_date, slot, session_no, main_min) from a year calendar in `confData = {...};`.

    A map of days for each month, five times a day. A time is absolute or an offset (+m) from the start in
    `calendar`, whose places are 0, 2, 3, 4, 5; times outside their slot's window are left out. jumua, jumua2 and
    jumua3 are the sessions of every Friday that the calendar has; those that are missing aren't counted.
    """
    raw = F.regexp_extract("html", r"(?s)confData\s*=\s*(\{.*?\})\s*[;<]", 1)
    shape = "struct<calendar:array<map<string,array<string>>>,iqamaCalendar:array<map<string,array<string>>>,jumua:string,jumua2:string,jumua3:string>"
    conf = pages.select("page_id", F.from_json(raw, shape).alias("c")).where("c is not null")
    fridays = F.filter(F.array("c.jumua", "c.jumua2", "c.jumua3"), lambda t: F.coalesce(t, F.lit("")) != "")
    # each day gets its own starts before it becomes a row: the calendar isn't copied into every row
    of_month = lambda days, m: F.transform(F.map_entries(days), lambda e: F.struct(m.alias("month"), e["key"].alias("day"), e["value"].alias("times"), F.try_element_at(F.get("c.calendar", m), e["key"]).alias("starts")))
    months = F.flatten(F.filter(F.transform("c.iqamaCalendar", of_month), lambda x: x.isNotNull()))
    days = conf.select("page_id", fridays.alias("fridays"), F.inline(months))
    date = F.try_to_date(F.concat_ws("-", F.lit(str(year)), F.lpad((F.col("month") + 1).cast("string"), 2, "0"), F.lpad("day", 2, "0")))
    # here and below filtered as arrays: a filter of rows would be pushed below and work the values out twice
    days = days.select("page_id", "fridays", "times", "starts", F.explode(F.filter(F.array(date), lambda d: d.isNotNull())).alias("slot_date"))
    names, places = (F.array(*map(F.lit, x)) for x in (("fajr", "dhuhr", "asr", "maghrib", "isha"), (0, 2, 3, 4, 5)))
    session = lambda slot, n, time, start: F.struct(slot.alias("slot"), n.cast("int").alias("session_no"), time.alias("time"), start.alias("start"))
    daily = F.transform(F.slice("times", 1, 5), lambda t, k: session(F.get(names, k), F.lit(1), t, F.get("starts", F.get(places, k))))
    friday = F.transform("fridays", lambda t, k: session(F.lit("jumuah"), k + 1, t, F.lit(None).cast("string")))
    none = F.filter(friday, lambda _: F.lit(False))
    sessions = F.concat(F.coalesce(daily, none), F.when(F.weekday("slot_date") == 4, friday).otherwise(none))
    slots = days.select("page_id", "slot_date", F.inline(sessions))
    read = lambda c: afternoon_where_due(minutes_loose(F.col(c)), F.col("slot"))
    offset = F.regexp_extract(F.trim("time"), r"^\+(\d{1,3})$", 1).try_cast("int")
    absolute = F.when((F.col("slot") == "jumuah") | F.contains("time", F.lit(":")), read("time"))
    when = F.coalesce(absolute, plus_minutes(read("start"), offset))
    fits = lambda m: F.when(F.col("slot") == "jumuah", m.isNotNull()).otherwise(in_window(m, F.col("slot")))
    return slots.select("page_id", "slot_date", "slot", "session_no", F.explode(F.filter(F.array(when), fits)).alias("main_min"))


def as_candidates(rows: DataFrame, sources: DataFrame, contract: str, gate_passed: Column) -> DataFrame:
    """Extracted rows as candidates of their page's source, with their evidence as JSON."""
    evidence = F.to_json(F.struct(F.lit(contract).alias("contract"), gate_passed.alias("gate_passed"), F.col("page_id").alias("artifact_id")))
    return rows.where("main_min is not null").join(sources, "page_id").select("source_id", "place_id", "slot_date", "slot", "main_min", evidence.alias("evidence"))
