"""normalize a mixed-format time text column to epoch seconds.

Tried in order, first match wins (text trimmed):
1. an integer: taken as epoch seconds;
2. RFC 3339 (``2024-01-05T10:00:00+01:00``, ``...Z``, a fraction of any length);
3. date and time, after mapping ``+``, ``_`` and ``T`` to a space: five date
   formats times four time formats;
4. the raw text as a date alone (midnight);
5. the raw text as a time alone (on ``today``).
The period of 12-hour times may be in either case (``02:30 PM``, ``02:30 pm``).
Wall-clock forms are read at the fixed UTC offset ``offset_seconds``. Text that
matches nothing gives NULL (send it to quarantine). No text has the shape of two forms, so its shape names the one
format to try: a row is parsed once, with a single ``try_to_timestamp`` - no UDF; the result
does not depend on the session time zone because the offset is part of the
parsed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted formats, in the order they are tried.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "MM-dd-yyyy", "MM/dd/yyyy"]
TIME_FORMATS = ["HH:mm", "HH:mm:ss", "hh:mm a", "hh:mm:ss a"]
RFC3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"
#: The fraction of an RFC 3339 time, any number of digits: whole seconds are wanted, so it goes.
RFC3339_FRACTION = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\.\d+(Z|[+-]\d{2}:\d{2})$"

#: The shapes of `DATE_FORMATS` and `TIME_FORMATS`, in their order; years have four digits or more, and may have a sign.
_YEAR = "[+-]?[0-9]{4,}"
DATE_SHAPES = [f"{_YEAR}-[0-9]{{2}}-[0-9]{{2}}", f"{_YEAR}/[0-9]{{2}}/[0-9]{{2}}", f"{_YEAR}[.][0-9]{{2}}[.][0-9]{{2}}", f"[0-9]{{2}}-[0-9]{{2}}-{_YEAR}", f"[0-9]{{2}}/[0-9]{{2}}/{_YEAR}"]
TIME_SHAPES = ["[0-9]{2}:[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}", "[0-9]{2}:[0-9]{2} [AaPp][Mm]", "[0-9]{2}:[0-9]{2}:[0-9]{2} [AaPp][Mm]"]
RFC3339_SHAPE = f"^{_YEAR}-[0-9]{{2}}-[0-9]{{2}}[Tt][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}.*[Zz0-9]$"


def offset_text(offset_seconds: int) -> str:
    sign = "+" if offset_seconds >= 0 else "-"
    a = abs(int(offset_seconds))
    return f"{sign}{a // 3600:02d}:{(a % 3600) // 60:02d}"


def split_times(df: DataFrame, text: str, out: str, offset_seconds: int = 0, today: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``out``, rejected rows with a ``reject`` reason). A null text is no reject: its time is null."""
    parsed = df.withColumn(out, parse_time_column(text, offset_seconds, today))
    bad = F.col(out).isNull() & F.col(text).isNotNull()
    return parsed.filter(~bad), parsed.filter(bad).drop(out).withColumn("reject", F.lit("unknown time format"))


def parse_time_column(text: Column | str, offset_seconds: int = 0, today: str | None = None) -> Column:
    """Epoch seconds (LONG) of a time text, or NULL when no format matches."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    norm = F.translate(raw, "+_T", "   ")
    off = F.lit(" " + offset_text(offset_seconds))
    zone, midnight = F.lit(" XXX"), F.lit(" 00:00:00")

    def form(text: Column, fmt: Column) -> Column:
        return F.struct(text.alias("text"), fmt.alias("fmt"))

    def named(text: Column, shapes: list[str], formats: list[str], pattern: str) -> Column:
        """The format whose shape ``text`` has."""
        first, *rest = [(text.rlike(pattern.format(shape)), F.lit(fmt)) for shape, fmt in zip(shapes, formats, strict=True)]
        out = F.when(*first)
        for case in rest:
            out = out.when(*case)
        return out

    # a date and the time after it are told apart on their own: nine shapes for twenty formats
    both = F.concat(named(norm, DATE_SHAPES, DATE_FORMATS, "^{} "), F.lit(" "), named(norm, TIME_SHAPES, TIME_FORMATS, "^[^ ]+ {}$"), zone)
    shape = F.when(raw.rlike(RFC3339_SHAPE), form(F.regexp_replace(raw, RFC3339_FRACTION, "$1$2"), F.lit(RFC3339_FORMAT)))
    shape = shape.when(norm.rlike("^[^ ]+ [0-9]{2}:"), form(F.concat(norm, off), both))
    if today is not None:
        shape = shape.when(raw.rlike("^[0-9]{2}:"), form(F.concat(F.lit(today + " "), raw, off), F.concat(F.lit("yyyy-MM-dd "), named(raw, TIME_SHAPES, TIME_FORMATS, "^{}$"), zone)))
    shape = shape.otherwise(form(F.concat(raw, midnight, off), F.concat(named(raw, DATE_SHAPES, DATE_FORMATS, "^{}$"), F.lit(" HH:mm:ss"), zone)))
    # in an array the shape is found once, though its text and its format are both read
    parsed = F.transform(F.array(shape), lambda f: F.unix_seconds(F.try_to_timestamp(f["text"], f["fmt"])))
    number = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint"))
    return F.coalesce(number, F.element_at(parsed, 1)).cast("long")
