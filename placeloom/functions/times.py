"""Slot times as minutes of the day, slot names and British dates, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The slots in their order, spellings, and label keywords.
SLOTS = ("fajr", "dhuhr", "asr", "maghrib", "isha", "jumuah")
DAILY = SLOTS[:5]
SPELLINGS = {"fajr": "fajr", "dhuhr": "dhuhr", "zuhr": "dhuhr", "asr": "asr", "maghrib": "maghrib", "isha": "isha", "jumuah": "jumuah", "jumah": "jumuah", "jummah": "jumuah"}
KEYWORDS = {
    "fajr": ("fajr", "fajar", "sehri", "suhoor", "subh"),
    "dhuhr": ("dhuhr", "zuhr", "zohar", "zohr", "thuhr", "thuhur"),
    "asr": ("asr", "asar"),
    "maghrib": ("maghrib", "maghrebin", "magrib", "iftaar", "iftar"),
    "isha": ("isha", "ishaa", "esha", "eshaa", "night"),
    "jumuah": ("jumuah", "jumma", "jummah", "jumah", "friday"),
}
# Plausible windows (first and last minute of the day).
WINDOWS = {"fajr": (120, 450), "dhuhr": (690, 960), "asr": (810, 1200), "maghrib": (930, 1350), "isha": (1020, 1439), "jumuah": (690, 930)}
# Months by name.
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}


# Words for minutes after a number, endings of ordinal days, and the century of a stated year.
MINUTE_WORDS = ("minute", "min", "minutes", "mins", "m")
ORDINAL_ENDINGS = ("st", "nd", "rd", "th")
CENTURY = "20"

# Metadata keys that may date a record, the first that can be read counts.
RECORD_KEYS = ("source_record_updated_at", "source_record_created_at", "last_updated", "updated_at", "timestamp", "created_at", "date")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def slot_order(slot: Column) -> Column:
    """1 to 6 in the day's order; null for an unknown slot."""
    return F.try_element_at(literal_map({s: i for i, s in enumerate(SLOTS, 1)}), slot)


def minutes_of(c: Column) -> Column:
    """Strict H:MM or HH:MM as minutes; blank and bad are null."""
    hour = F.regexp_extract(F.trim(c), r"^(\d{1,2}):(\d{2})$", 1).try_cast("int")
    minute = F.regexp_extract(F.trim(c), r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def minutes_error(c: Column) -> Column:
    """What is wrong with a strict time; null if it is good or blank."""
    bare = F.trim(c)
    shape = bare.rlike(r"^\d{1,2}:\d{2}$")
    return F.when((bare != "") & ~shape, F.concat(F.lit("invalid time format (expected HH:MM): "), c)).when(shape & minutes_of(c).isNull(), F.concat(F.lit("invalid time value: "), c))


def clock(minutes: Column) -> Column:
    """Minutes of the day as HH:mm."""
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _all_digits(fields: Column) -> Column:
    return F.forall(fields, lambda x: x.rlike("^[0-9]+$"))


def minutes_loose(c: Column) -> Column:
    """h, h.mm or h:mm, with or without am or pm and a full stop, as minutes; anything else is null."""
    def of_fields(fields: Column, half: Column) -> Column:
        minute = F.coalesce(F.get(fields, F.lit(1)), F.lit("00"))
        shaped = (F.size(fields) <= 2) & _all_digits(fields) & (F.char_length(fields[0]) <= 2) & (F.char_length(minute) == 2)

        def of_hour(hour: Column) -> Column:
            # twelve o'clock is hour 0 of its half
            return F.when(half.isin("am", "pm") & (hour <= 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(hour)

        total = _let(of_hour(fields[0].try_cast("int")), lambda h: F.when(h <= 23, h * 60))
        return F.when(shaped & (minute.try_cast("int") <= 59), total + minute.try_cast("int"))

    def of_text(bare: Column) -> Column:
        half = F.right(bare, F.lit(2))
        rest = F.when(half.isin("am", "pm"), F.rtrim(F.regexp_replace(bare, "..$", ""))).otherwise(bare)
        return _let(F.split(rest, "[:.]"), lambda fields: of_fields(fields, half))

    return _let(F.regexp_replace(F.lower(F.trim(c)), r"[.]$", ""), of_text)


def in_window(minutes: Column, slot: Column) -> Column:
    low, high = (F.try_element_at(literal_map({k: v[i] for k, v in WINDOWS.items()}), slot) for i in (0, 1))
    return (minutes >= low) & (minutes <= high)


def afternoon_where_due(minutes: Column, slot: Column) -> Column:
    """Twelve hours later, where a time before noon is implausible for the slot and the later one isn't."""
    due = lambda m: (m < 720) & ~in_window(m, slot) & in_window(m + 720, slot)
    return _let(minutes, lambda m: F.when(due(m), m + 720).otherwise(m))


def slot_of(c: Column) -> Column:
    """The slot of a strict spelling; null for others."""
    return F.try_element_at(literal_map(SPELLINGS), F.lower(F.trim(c)))


def slot_of_label(c: Column) -> Column:
    """The first slot, in the day's order, of which a keyword stands in a free label."""
    bare = F.lower(F.trim(c))
    found = F.lit(None).cast("string")
    for slot in reversed(SLOTS):
        found = F.when(bare.rlike("|".join(KEYWORDS[slot])), slot).otherwise(found)
    return found


def offset_minutes(c: Column) -> Column:
    """Minutes of a text such as '10 mins after': the first number of up to three digits with a word for minutes after it."""
    # a number, white space or none, a word, and then no further letter, digit or underscore
    number, word = r"[0-9]{1,3}", "|".join(sorted(MINUTE_WORDS, key=len, reverse=True))
    found = F.regexp_extract(F.lower(c), rf"{number}\s*({word})(?![0-9a-z_])", 0)
    return F.regexp_extract(found, number, 0).try_cast("int")


def plus_minutes(minutes: Column, more: Column) -> Column:
    return F.pmod(minutes + more, F.lit(1440))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"[\s,]+"), lambda t: t != "")


def _ordinal(t: Column) -> Column:
    """A token such as 1, 02 or 21st as a number; null for others."""
    low = F.lower(t)
    bare = F.when(F.right(low, F.lit(2)).isin(*ORDINAL_ENDINGS), F.left(low, F.char_length(low) - 2)).otherwise(low)
    return F.when(F.char_length(bare).between(1, 2) & (F.translate(bare, "0123456789", "") == ""), bare.try_cast("int"))


def _stated_year(c: Column) -> Column:
    """The first run of four digits that begins with the century."""
    runs = F.filter(F.split(c, r"[^0-9]+"), lambda x: (F.char_length(x) == 4) & x.startswith(CENTURY))
    return F.get(runs, F.lit(0))


def british_date(c: Column, default_year: int) -> Column:
    """d/m, d/m/y, '1st June', 'June 1, 2026' as a date, day first; a day that isn't there is null."""
    bare = F.trim(c)
    fields = F.split(bare, "[/.-]")
    sizes = F.transform(fields, lambda x: F.char_length(x))
    short = F.forall(F.slice(sizes, 1, 2), lambda n: n <= 2) & F.forall(F.slice(sizes, 3, 1), lambda n: n.between(2, 4))
    numeric = F.size(fields).isin(2, 3) & _all_digits(fields) & short
    part = lambda k: F.get(fields, F.lit(k - 1)).try_cast("int")
    year = F.coalesce(part(3) + F.when(part(3) < 100, 2000).otherwise(0), F.lit(default_year))
    stated = _stated_year(bare)
    rest = F.when(stated.isNotNull(), F.replace(bare, stated, F.lit(" "))).otherwise(bare)
    month = F.get(F.filter(F.transform(_tokens(rest), lambda t: F.try_element_at(literal_map(MONTHS), F.rtrim(F.lower(t), F.lit(".,")))), lambda m: m.isNotNull()), F.lit(0))
    day = F.get(F.filter(F.transform(_tokens(rest), _ordinal), lambda d: d.isNotNull()), F.lit(0))
    return F.when(numeric, _date(year, part(2), part(1))).otherwise(_date(F.coalesce(stated.try_cast("int"), F.lit(default_year)), month, day))


def day_of_month(c: Column) -> Column:
    """A bare day cell ('1', '21st', 'Mon 1') as 1 to 31; two numbers or other words are null."""
    tokens = _tokens(c)
    days = F.filter(F.transform(tokens, _ordinal), lambda d: d.isNotNull())
    words = F.filter(tokens, lambda t: _ordinal(t).isNull())
    weekdays = F.forall(words, lambda t: F.substring(F.rtrim(F.lower(t), F.lit(".")), 1, 3).isin("mon", "tue", "wed", "thu", "fri", "sat", "sun"))
    day = F.get(days, F.lit(0))
    return F.when((F.size(days) == 1) & weekdays & day.between(1, 31), day)


def month_dates(first: Column) -> Column:
    """All dates of the month that a date lies in."""
    start = F.trunc(first, "month")
    return F.sequence(start, F.last_day(first))


def expected_slots(on: Column) -> Column:
    """The five daily slots, and the Friday one on Fridays."""
    daily = F.array(*[F.lit(s) for s in DAILY])
    return F.when(F.weekday(on) == 4, F.concat(daily, F.array(F.lit("jumuah")))).otherwise(daily)


def record_date(metadata: Column) -> Column:
    """The date of a record by its metadata (JSON text)."""
    return F.coalesce(*[F.try_to_date(F.get_json_object(metadata, f"$.{k}")) for k in RECORD_KEYS])
