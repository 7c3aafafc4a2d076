"""Column expressions over the post schema.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric value of a sentiment label (anything else is 0).
LABEL_VALUES = {"POSITIVE": 1.0, "NEGATIVE": -1.0}
# Short labels some classifiers return, mapped to full labels.
LABEL_ALIASES = {"POS": "POSITIVE", "NEG": "NEGATIVE", "NE": "NEUTRAL"}
# Weekday names in calendar order (Monday first).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def engagement_total(engagement="engagement") -> Column:
    """Sum of every value in the engagement map (0 for null/empty)."""
    e = _c(engagement)
    return F.coalesce(F.aggregate(F.map_values(e), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))


def engagement_metric(engagement, *keys: str) -> Column:
    """P5: value of the first key present in the map, else 0."""
    e = _c(engagement)
    return F.coalesce(*[F.try_element_at(e, F.lit(k)) for k in keys], F.lit(0.0))


def likes(engagement="engagement") -> Column:
    return engagement_metric(engagement, "likes", "score")


def shares(engagement="engagement") -> Column:
    return engagement_metric(engagement, "retweets", "num_comments")


def replies(engagement="engagement") -> Column:
    return engagement_metric(engagement, "replies")


def label_value(label) -> Column:
    """POSITIVE → 1, NEGATIVE → −1, anything else → 0."""
    lab = _c(label)
    return (F.when(lab == "POSITIVE", F.lit(1.0))
             .when(lab == "NEGATIVE", F.lit(-1.0))
             .otherwise(F.lit(0.0)))


def canonical_label(raw) -> Column:
    """Strip + upper, expand short labels, keep anything else."""
    up = F.upper(F.trim(_c(raw)))
    aliases = F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, up), up)


def scoring_text(title="title", content="content") -> Column:
    """``title + ' ' + content`` when the title is non-empty, else content."""
    t, c = _c(title), F.coalesce(_c(content), F.lit(""))
    return F.when(F.length(t) > 0, F.concat(t, F.lit(" "), c)).otherwise(c)


def truncate_strip(text, max_length: int) -> Column:
    """Strip; if longer than ``max_length`` keep ``max_length-3`` chars + '...'."""
    s = F.trim(F.coalesce(_c(text), F.lit("")))
    return F.when(F.char_length(s) <= max_length, s).otherwise(
        F.concat(F.substring(s, 1, max_length - 3), F.lit("...")))


def preview(text, n: int = 200) -> Column:
    """First ``n`` chars + '...' only when the text is longer."""
    s = F.coalesce(_c(text), F.lit(""))
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def truncate_suffix(text, max_length: int = 100, suffix: str = "...") -> Column:
    """Cut so the result including the suffix has ``max_length`` chars; null → ''."""
    s = _c(text)
    return (F.when(s.isNull(), F.lit(""))
             .when(F.char_length(s) <= max_length, s)
             .otherwise(F.concat(F.substring(s, 1, max_length - len(suffix)), F.lit(suffix))))


def weekday_name(ts="timestamp") -> Column:
    """English weekday name."""
    return F.date_format(_c(ts), "EEEE")


def date_string(ts="timestamp") -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def iso_timestamp(ts="timestamp") -> Column:
    """Timestamp text with microseconds (stable across engines)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def format_count(x) -> Column:
    """Thousands separators for integers, two decimals otherwise."""
    v = _c(x)
    return F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2))


def format_percent(x) -> Column:
    """One decimal and a percent sign."""
    return F.format_string("%.1f%%", _c(x).cast("double"))


def date_range_label(start, end, days) -> Column:
    """Human readable range; falls back to ``N days`` without bounds."""
    s, e = _c(start), _c(end)
    same_day = F.to_date(s) == F.to_date(e)
    same_month = (F.month(s) == F.month(e)) & (F.year(s) == F.year(e))
    same_year = F.year(s) == F.year(e)
    return (F.when(s.isNull() | e.isNull(), F.concat(_c(days).cast("string"), F.lit(" days")))
             .when(same_day, F.date_format(s, "MMMM dd, yyyy"))
             .when(same_month, F.concat(F.date_format(s, "MMMM dd"), F.lit(" - "), F.date_format(e, "dd, yyyy")))
             .when(same_year, F.concat(F.date_format(s, "MMMM dd"), F.lit(" - "), F.date_format(e, "MMMM dd, yyyy")))
             .otherwise(F.concat(F.date_format(s, "MMMM dd, yyyy"), F.lit(" - "),
                                 F.date_format(e, "MMMM dd, yyyy"))))


EPOCH_NTZ = "1970-01-01 00:00:00"


def micros_between(start, end) -> Column:
    """Microseconds from ``start`` to ``end`` (wall-clock, session time zone ignored)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def ntz_from_epoch_seconds(seconds) -> Column:
    """Epoch seconds → UTC wall-clock TIMESTAMP_NTZ, independent of the session time zone."""
    micros = F.round(_c(seconds).cast("double") * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def ntz_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from text (or a naive datetime), no time-zone conversion."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")
