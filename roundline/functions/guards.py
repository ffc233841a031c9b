"""Rules over single readings, windows and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(value: Column, low: float, high: float) -> Column:
    """The value inside a domain, else null."""
    return F.when(value.between(low, high), value)


def guarded_method(k: Column, d: Column, a: Column, method: Column) -> Column:
    """A counter without both companions is an incomplete triple."""
    return F.when(k.isNotNull() & d.isNull() & a.isNull(), "triple_incomplete").otherwise(method)


def guarded_counter(k: Column, d: Column, a: Column) -> Column:
    return F.when(d.isNotNull() | a.isNotNull(), k)


def arbitrated(value: Column, conf: Column, left: Column, left_conf: Column) -> Column:
    """(value, conf) of the whole cell or of its left half, which wins where the
    whole cell is unread, 15 or more, or an 8 or 9 that is 4 or more above it."""
    left_sound = F.coalesce(left.between(0, 40) & (left_conf >= 0.45), F.lit(False))
    cover = value.isNull() | (value >= 15)
    tail = F.coalesce((value >= 8) & (value < 10) & (left < value) & (value - left >= 4) & (left_conf >= 0.5), F.lit(False))
    sound = F.coalesce(value.between(0, 40) & (conf >= 0.45), F.lit(False))
    pick = lambda a, b: F.when(left_sound & (cover | tail), a).when(sound, b).when(left_sound, a).otherwise(b)
    return F.struct(pick(left, value).alias("value"), pick(left_conf, conf).alias("conf"))


def without_tens(values: Column, previous: Column) -> Column:
    """Candidates without 10, 20, 30 ... that come from nowhere or from a jump of
    ten; all of them if none is left."""
    kept = F.filter(values, lambda d: ~((d >= 10) & (d % 10 == 0) & (previous.isNull() | (d - previous == 10))))
    return F.when(F.size(kept) > 0, kept).otherwise(values)


def elimination_state(red: Column, blue: Column) -> Column:
    return F.when((red >= 1) & (blue >= 1), "active").when((red == 0) & (blue >= 1), "red_eliminated").when((blue == 0) & (red >= 1), "blue_eliminated").otherwise("unknown")


def layout(width: Column) -> Column:
    return F.when((width > 0) & (width < 1800), "sponsor").otherwise("fullscreen")


def read_quality(hits: Column, misses: Column, row_misses: Column) -> Column:
    """Share of hits, -1 without any reading."""
    return F.coalesce(F.try_divide(hits, hits + misses + row_misses), F.lit(-1.0))


def present(value: Column) -> Column:
    """0.0 counts as missing."""
    return F.nullif(value, F.lit(0.0))


def detection_start(first_kill: Column, start: Column) -> Column:
    return F.coalesce(present(first_kill), start)


def detection_end(d1: Column, ace: Column, end: Column) -> Column:
    return F.greatest(d1, F.coalesce(present(ace), end))


def is_width_zero(times: Column) -> Column:
    return (F.size(times) >= 2) & (F.array_max(times) == F.array_min(times))


def is_ace(kills: Column, resets: Column, times: Column, samples: Column, need: int = 3, span: float = 90.0, least: int = 10) -> Column:
    """Exactly ``need`` kills, no reset, in a short span and on enough readings."""
    wide = F.coalesce(F.get(times, F.lit(need - 1)) - F.get(times, F.lit(0)), F.lit(0.0))
    return (kills == need) & (resets == 0) & (wide <= span) & (samples >= least)


def event_window(t: Column, before: Column, after: Column) -> tuple[Column, Column]:
    start = F.greatest(F.lit(0.0), t - before)
    return start, F.greatest(start + 1, t + after)


def ace_window(start: Column, end: Column, first_kill: Column, ace: Column) -> tuple[Column, Column]:
    """Clip around a round: from 6 s before it or 14 s before the first kill, to
    1.5 s after it or 12 s after the last; 12 to 55 s long."""
    s = F.greatest(F.lit(0.0), F.least(start - 6.0, first_kill - 14.0))
    e = F.when(ace.isNull(), end + 1.5).otherwise(F.least(end + 1.5, F.greatest(ace + 12.0, end + 0.5)))
    cut = F.when(e - s > 55.0, e - 55.0).otherwise(s)
    return F.when(e - cut < 12.0, F.greatest(F.lit(0.0), e - 12.0)).otherwise(cut), e


def lead_window(start: Column, previous_end: Column, lead: float = 35.0, max_lead: float = 75.0, tail: float = 4.0) -> tuple[Column, Column]:
    """Clip before a scoreboard: the play time within bounds, not before the previous end."""
    gap = F.greatest(F.lit(0.0), start - previous_end)
    used = F.greatest(F.lit(lead), F.least(F.lit(max_lead), gap))
    return F.greatest(previous_end, start - used), start + tail


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Half-open intervals that share more than an end."""
    return (a1 < b2) & (b1 < a2)


def touches(a1: Column, a2: Column, b1: Column, b2: Column, tolerance: float = 0.0) -> Column:
    """Closed intervals that meet within a tolerance."""
    return (a1 - tolerance <= b2) & (b1 <= a2 + tolerance)


def read_failure(mode: Column, n_rows: Column, has_header: Column, name: Column, conf: Column, least: float = 0.3) -> Column:
    blank = F.coalesce(name, F.lit("")) == ""
    unknown = F.when(n_rows == 0, "unknown_no_ocr").when(~has_header, "unknown_no_header").otherwise("unknown_header_ocr_garbled")
    return F.when(mode == "unknown", unknown).when((mode == "scouter") & blank, "scouter_dot_miss").when(~blank & (conf < least), "low_conf").when(blank, "empty_nick").otherwise("ok")


def accepted_window(binary: Column, is_top: Column, type_score: Column, binary_least: float = 0.55, type_least: float = 0.35) -> Column:
    """Binary score first, then the type score (null: binary only)."""
    return (binary >= binary_least) & is_top & (type_score.isNull() | (type_score >= type_least))


def digits_value(digits: Column) -> Column:
    """Number of an array of digits; a missing digit makes it null."""
    return F.when((F.size(digits) > 0) & F.forall(digits, lambda d: d.isNotNull()), F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 10 + d))


def voted(values: Column, value: int, least: int = 3) -> Column:
    """Whether ``least`` of several thresholds read ``value``."""
    return F.size(F.filter(values, lambda x: x == value)) >= least


def player_wins(row_index: Column, red: Column, blue: Column) -> Column:
    """Wins of the player's own team: the first three rows are red."""
    return F.when(row_index < 3, red).when(row_index >= 3, blue)


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs of x1, y1, x2, y2) over their union."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: F.greatest(F.lit(1), (x["x2"] - x["x1"]) * (x["y2"] - x["y1"]))
    return w * h / F.greatest(F.lit(1.0), (area(a) + area(b) - w * h).cast("double"))


def clamped_box(box: Column, width: Column, height: Column) -> Column:
    """Box inside a picture, at least one pixel wide and high."""
    inside = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    x1 = inside(box["x1"], F.lit(0), F.greatest(F.lit(0), width - 1))
    y1 = inside(box["y1"], F.lit(0), F.greatest(F.lit(0), height - 1))
    return F.struct(x1.alias("x1"), y1.alias("y1"), inside(box["x2"], x1 + 1, width).alias("x2"), inside(box["y2"], y1 + 1, height).alias("y2"))


def warnings(**flags: Column) -> Column:
    """Names of the flags that hold."""
    return F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in flags.items())))
