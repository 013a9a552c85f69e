"""Text and number expressions: folding, fingerprints, folds, shape validators, display."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold as fold

UNIT_SEPARATOR = "\u001f"


#: The fold of any script; the same as ``fold``, which once knew Latin letters only.
fold_any = fold


def month(day: Column) -> Column:
    return F.substring(day, 1, 7)


def fingerprint(*fields: Column) -> Column:
    """sha256 of the fields with U+001F between; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def canonical(number: Column) -> Column:
    """The spelling used in fingerprints: no trailing zeros after a point, null empty."""
    s = number.cast("string")
    return F.coalesce(F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s), F.lit(""))


def review_fold(review_id: Column, folds: int = 5) -> Column:
    """sha256 of the id, as a number, modulo 5: since 16 = 1 mod 5, the sum of its hex digits."""
    if folds != 5:
        raise ValueError("digit sums give the remainder of five only")
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(F.sha2(review_id, 256), i, F.lit(1)), 16, 10).cast("int"))
    return (F.aggregate(digits, F.lit(0), lambda a, x: a + x) % folds).cast("int")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def joined_text(title: Column, body: Column) -> Column:
    """Title, line end, body; blank parts are left out."""
    part = lambda c: F.nullif(stripped(c), F.lit(""))
    return stripped(F.concat_ws("\n", part(title), part(body)))


# --- shape validators: a value or null -------------------------------------


def decimal_shape(c: Column) -> Column:
    return c.rlike(r"^-?[0-9]+([.,][0-9]+)?\z")


def amount(c: Column) -> Column:
    """A positive number spelled with a point or a comma, else null."""
    value = F.when(decimal_shape(F.trim(c)), F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(value > 0, value)


def count_value(c: Column) -> Column:
    """0 to 2**31 - 1 in at most ten ASCII digits."""
    n = F.when(c.rlike(r"^[0-9]{1,10}\z"), c.try_cast("bigint"))
    return F.when(n <= 2147483647, n.try_cast("int"))


def euro_total(c: Column) -> Column:
    """Whole euros below 10**12."""
    n = F.when(c.rlike(r"^[0-9]{1,13}\z"), c.try_cast("bigint"))
    return F.when(n < 10**12, n)


def half_step(c: Column) -> Column:
    """A review rating by spelling: 1, 1.5, ... 5; 4.0 is not one of them."""
    return F.when(c.rlike(r"^([1-4](\.5)?|5)\z"), c.try_cast("decimal(2,1)"))


def page_rating(c: Column) -> Column:
    """At most two digits and 32 decimals, rounded half-even to three places, 0 to 5."""
    v = F.when(c.rlike(r"^[0-9]{1,2}(\.[0-9]{1,32})?\z"), F.bround(c.try_cast("decimal(38,32)"), 3))
    return F.when((v >= 0) & (v <= 5), v).try_cast("decimal(4,3)")


#: Precision, scale and greatest value of the decimal measures; the least is 0.
MEASURES = {"rating": (4, 3, "5"), "one_star_share": (4, 3, "1"), "response_rate": (4, 3, "1"), "response_delay_days": (5, 1, "9999.9")}


def measure(name: str, c: Column) -> Column:
    """A measure exactly as written, inside its range; more digits than the column holds are refused, not rounded."""
    precision, scale, most = MEASURES[name]
    whole = F.substring_index(c, ".", 1)
    places = F.when(c.contains("."), F.char_length(c) - F.char_length(whole) - 1).otherwise(0)
    fits = c.rlike(r"^[0-9]+(\.[0-9]+)?\z") & (F.char_length(whole) <= precision - scale) & (places <= scale)
    value = F.when(fits, c).try_cast(f"decimal({precision},{scale})")
    return F.when(value <= F.lit(most).cast(f"decimal({precision},{scale})"), value)


def real_day(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c)


def real_instant(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), c)


def printed_day(c: Column) -> Column:
    """The day an ISO instant with offset prints, without time zone arithmetic."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+([+-][0-9]{2}:[0-9]{2}|Z)\z"), real_day(F.substring(c, 1, 10)))


def slashed_day(c: Column) -> Column:
    """dd/mm/yyyy to ISO; impossible days are null."""
    return F.when(c.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), F.date_format(F.try_to_date(c, "dd/MM/yyyy"), "yyyy-MM-dd"))


def reply_labels(reply: Column, labels: Iterable[str]) -> Column:
    """Labels of a closed set that occur as whole tokens of a reply."""
    tokens = F.transform(F.split(F.lower(reply), r"[^a-z-]+"), lambda t: F.trim(t, F.lit("-")))
    return F.array_intersect(F.array(*[F.lit(x) for x in labels]), tokens)


# --- rounding and display ----------------------------------------------------

#: Decimals by unit.
PLACES = {"eur": 2, "count": 0, "rate": 6, "logeur": 6, "days": 2}


def rounded(unit: str, c: Column) -> Column:
    if unit not in PLACES:
        raise ValueError(f"unknown unit {unit!r}; expected one of {sorted(PLACES)}")
    return F.bround(c, 0) if unit == "count" else F.round(c, PLACES[unit])


#: Display forms by unit.
FORMS = {"stars": "%.1f★", "pct": "%.1f%%", "days": "%.1f days", "count": "%,.0f", "eur": "€%,.2f", "logeur": "%.6f log-euros", "": "%.2f"}


def displayed(unit: str, c: Column) -> Column:
    """A number as text in its display unit; a unit outside the closed set raises."""
    if unit not in FORMS:
        raise ValueError(f"unknown display unit {unit!r}; expected one of {sorted(FORMS)}")
    value = c * 100 if unit == "pct" else F.bround(c, 0) if unit == "count" else c
    return F.format_string(FORMS[unit], value.cast("double"))


def rounded_up(c: Column) -> Column:
    """Up to one significant figure, for axis bounds."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    return F.when(c > 0, F.ceil(c / step) * step)
