"""Review dates: epoch numbers in three units, ISO texts and the usual written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.numbers import to_number
from opinara.functions.text import bind

# Shape of a written date, and how to read it. A form is only tried on texts of its shape: a failed attempt costs
# far more than the test.
WRITTEN_FORMS = (
    (r"\d{4}/\d{1,2}/\d{1,2}", ("yyyy/M/d",)),
    (r"\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy", "d/M/yyyy")),
    (r"\d{1,2}-\d{1,2}-\d{4}", ("M-d-yyyy", "d-M-yyyy")),
    (r"\d{8}", ("yyyyMMdd",)),
    (r"\p{L}{3} \d{1,2}, \d{4}", ("MMM d, yyyy",)),
    (r"\p{L}{4,} \d{1,2}, \d{4}", ("MMMM d, yyyy",)),
    (r"\d{1,2} \p{L}{3} \d{4}", ("d MMM yyyy",)),
    (r"\d{1,2} \p{L}{4,} \d{4}", ("d MMMM yyyy",)),
    (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}", ("yyyy/M/d H:mm:ss",)),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", ("M/d/yyyy H:mm:ss",)),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", ("M/d/yyyy H:mm",)),
)
MILLIS_ABOVE = 1e10
SECONDS_ABOVE = 1e8
PER_DAY = {"s": 86400.0, "ms": 86400.0 * 1e3, "ns": 86400.0 * 1e9}
FIRST_DAY, LAST_DAY = -719162, 2932896  # years 1 to 9999


def _epoch_date(number: Column, unit: str | None = None) -> Column:
    if unit:
        days = number / F.lit(PER_DAY[unit])
    else:
        days = number / F.when(number > MILLIS_ABOVE, PER_DAY["ms"]).when(number > SECONDS_ABOVE, PER_DAY["s"]).otherwise(PER_DAY["ns"])
    return bind(days, lambda d: F.when((d >= FIRST_DAY) & (d < LAST_DAY + 1), F.date_from_unix_date(F.floor(d).cast("int"))))


def from_epoch(value: Column, unit: str | None = None) -> Column:
    """UTC date of an epoch number, whatever the session's time zone; null for what is no number or no date.

    Without a unit each value's size decides: milliseconds above 1e10, seconds above 1e8, nanoseconds below.
    """
    return bind(to_number(value), lambda number: _epoch_date(number, unit))


def from_text(value: Column, day_first: bool = False) -> Column:
    """Date of a written timestamp; the date as written when a time zone follows it, null for a time without a date.

    ``day_first`` says how 03/04/2024 is read; the other order is tried where the first gives no date.
    """
    whole = F.when(value.rlike(r"^\s*[+-]?\d{4}"), value.try_cast("timestamp"))
    iso_day = F.substring(value, 1, 10).try_cast("date")
    return bind(whole, lambda at: F.when(at.isNotNull(), F.coalesce(iso_day, F.to_date(at))).otherwise(_from_shape(value, day_first)))


def _from_shape(value: Column, day_first: bool) -> Column:
    """Date of a text in one of the written forms."""
    branches = F
    for shape, forms in WRITTEN_FORMS:
        ordered = forms[::-1] if day_first else forms
        read = F.coalesce(*[F.try_to_timestamp(value, F.lit(form)) for form in ordered])
        branches = branches.when(value.rlike(f"^{shape}$"), F.to_date(read))
    return branches


def parse_date(value: Column, unit: str | None = None, day_first: bool = False) -> Column:
    """Date of a raw value, null where it cannot be read as one. Without a unit each value is read by its own shape: eight
    digits that are a date, then numbers by their size, then written forms."""
    if unit == "text":
        return from_text(value.cast("string"), day_first)
    if unit:
        return from_epoch(value, unit)

    def of(text: Column) -> Column:
        compact = F.when(text.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))

        def of_number(number: Column) -> Column:
            return F.when(number.isNotNull(), F.coalesce(compact, _epoch_date(number))).otherwise(from_text(text, day_first))

        # the ISO form comes first: it needs one cast and no other test
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        return F.coalesce(iso, bind(to_number(text), of_number))

    return bind(value.cast("string"), of)


def year_month(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year, month)
