"""Scalar expressions: time bases, roundings, text clean-up, label rules. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that a reader takes for digits, and those digits.
MISREAD = ("lI|TnNwWpPBEoODQmMyYaARzZ", "1111111111100000000000222")


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60
    return (days * 86400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def tick_seconds(tick: Column, rate: float) -> Column:
    return tick / F.lit(float(rate))


def tick_millis(ticks: Column, rate: float) -> Column:
    return ticks / F.lit(float(rate)) * 1000


def half_even(value: Column, digits: int) -> Column:
    """Rounds ties to the even neighbour."""
    return F.bround(value, digits)


def tick_rate(ticks: Column, seconds: Column, fallback: int = 64) -> Column:
    """Whole ticks a second of a recording, at least a second long; the fallback if unknown."""
    return F.coalesce(F.bround(ticks / F.greatest(seconds, F.lit(1.0))).cast("int"), F.lit(fallback))


def window_samples(gap_s: float, rate: float) -> int:
    """Samples of a time window, cut to a whole number, one at least."""
    return max(1, int(gap_s * rate))


def read_digits(text: Column) -> Column:
    """Digits of a misread number: look-alike letters become digits, other characters go."""
    return F.regexp_replace(F.translate(F.trim(text), *MISREAD), "[^0-9]", "")


def read_count(text: Column) -> Column:
    """A count from 0 to 12 of at most two digits; 00 and 01 are a 10 that lost its start; else null."""
    digits = read_digits(text)
    fixed = F.when(digits.isin("00", "01"), "10").otherwise(digits)
    value = F.when((F.length(fixed) > 0) & (F.length(fixed) <= 2), fixed.cast("int"))
    return F.when(value.between(0, 12), value)


def renamed(name: Column, prefix: str, other: str) -> Column:
    """The name with another prefix, where it has that one."""
    return F.when(name.startswith(prefix), F.concat(F.lit(other), F.substring(name, len(prefix) + 1, 1 << 30))).otherwise(name)


def titled(label: Column) -> Column:
    """A label for people: underscores are spaces, words begin in upper case."""
    return F.initcap(F.translate(label, "_", " "))


def with_suffix(path: Column, suffix: str, other: str) -> Column:
    """The path with another suffix in place of that one; other paths get it added."""
    return F.concat(F.when(path.endswith(suffix), F.substring(path, F.lit(1), F.length(path) - len(suffix))).otherwise(path), F.lit(other))


def numbered(stem: str, number: Column, digits: int = 3) -> Column:
    """stem_007 and the like."""
    return F.format_string(f"{stem}_%0{digits}d", number)


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int")


def of_hundred(text: Column) -> Column:
    """n of "n / 100", or else the first number."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)\s*/\s*100", 1), F.lit("")).cast("int"), first_number(text))


def corners(x1: float, y1: float, x2: float, y2: float, width: Column, height: Column) -> Column:
    """Pixel corners of a region given in shares of a frame, rounded half to even."""
    at = {"x1": (x1, width), "y1": (y1, height), "x2": (x2, width), "y2": (y2, height)}
    return F.struct(*[F.bround(F.lit(share) * side).cast("int").alias(name) for name, (share, side) in at.items()])


def classify_profile(profile: Column) -> Column:
    """A digit label, 8 to 12, of a 15-column ink profile; null without ink from column 5 on.

    Two strokes at the left edge are 11; one digit further in is 8 or 9 by its
    right side's ink; a gap in the right half is 10, none 12.
    """
    at = lambda i: F.element_at(profile, i + 1)
    right = F.slice(profile, 6, 10)
    first_right = F.array_min(F.filter(F.transform(right, lambda v, i: F.when(v > 1, i + 5)), lambda x: x.isNotNull()))
    inked = F.transform(right, lambda v: v > 2)
    gap = F.exists(
        F.transform(inked, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
        lambda s: ~s["v"] & (s["i"] > 0) & (s["i"] < F.size(inked) - 1) & F.coalesce(F.get(inked, s["i"] - 1), F.lit(False)) & F.exists(F.slice(inked, s["i"] + 2, F.size(inked)), lambda x: x),
    )
    single = F.when(at(9) <= 6, 8).otherwise(9)
    return (
        F.when(first_right.isNull(), F.lit(None).cast("int"))
        .when((at(0) >= 5) & (at(0) >= at(2)), 11)
        .when((at(2) >= 5) & (at(2) > at(0)), single)
        .when(first_right >= 8, single)
        .when(gap, 10)
        .otherwise(12)
    )


def checked_label(raw: Column) -> Column:
    """label, confidence, notes of a labeller's JSON reply, code fences allowed; a label outside 8 to 12 is null, its confidence low."""
    reply = F.from_json(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), "label string, confidence string, notes string")
    label = reply["label"].try_cast("int")
    valid = label.between(8, 12)
    return F.struct(
        F.when(valid, label).alias("label"),
        F.when(F.coalesce(valid, F.lit(False)), F.coalesce(reply["confidence"], F.lit("low"))).otherwise("low").alias("confidence"),
        F.when(F.coalesce(valid, F.lit(False)), F.coalesce(reply["notes"], F.lit(""))).otherwise(F.concat(F.lit("invalid label; "), F.coalesce(reply["notes"], F.lit("")))).alias("notes"),
    )


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.bround(0.299 * r + 0.587 * g + 0.114 * b)


def brightness(b: Column, g: Column, r: Column) -> Column:
    return F.greatest(b, g, r)


def reddish(hue: Column, saturation: Column, value: Column) -> Column:
    """Whether a pixel lies in either red band of the hue circle (0 to 179), bright and full enough."""
    return (hue.between(0, 10) | hue.between(170, 180)) & (saturation >= 80) & (value >= 80)


def to_pixel(value: Column, low: float, high: float, origin: int, length: int) -> Column:
    """Axis map, cut to a whole pixel."""
    return (F.lit(origin) + (value - low) / (high - low) * length).cast("int")


def confidence_bar(confidence: Column, height: int) -> Column:
    return (F.least(confidence - 1, F.lit(0.4)) / 0.4 * height).cast("int")


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / max(whole, 1)."""
    return F.bround(part / F.greatest(whole, F.lit(1)), digits)


def video_time(time: Column | str, offset: float) -> Column:
    """A demo's time in the video that starts `offset` before it."""
    return (F.col(time) if isinstance(time, str) else time) + offset


def to_demo(rows: DataFrame, offset: float, time: str = "time_s") -> DataFrame:
    """Rows in video time as rows in the demo's."""
    return rows.withColumn(time, F.col(time) - offset)
