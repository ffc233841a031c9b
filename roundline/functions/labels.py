"""Labels, splits and stable ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: spellings of the clip labels
ALIASES = {
    "doublekill": "doublekill",
    "double": "doublekill",
    "double_kill": "doublekill",
    "더블킬": "doublekill",
    "더블": "doublekill",
    "multikill": "multikill",
    "multi": "multikill",
    "multi_kill": "multikill",
    "triple": "multikill",
    "triplekill": "multikill",
    "멀티킬": "multikill",
    "멀티": "multikill",
    "트리플": "multikill",
    "트리플킬": "multikill",
    "save": "save",
    "clutch": "save",
    "세이브": "save",
    "allkill": "allkill",
    "ace": "allkill",
    "올킬": "allkill",
    "에이스": "allkill",
    "background": "background",
    "normal": "background",
    "bg": "background",
    "일반": "background",
    "배경": "background",
}
#: fixed values: keywords of round labels in order of priority
KEYWORDS = (
    ("단일킬", "single_kill"),
    ("single", "single_kill"),
    ("전체스코어", "scoreboard"),
    ("스코어", "scoreboard"),
    ("scoreboard", "scoreboard"),
    ("win", "win"),
    ("defeat", "win"),
    ("로딩", "loading"),
    ("loading", "loading"),
    ("대기실", "lobby"),
    ("대기화면", "lobby"),
    ("lobby", "lobby"),
    ("방송종료", "stream_end"),
    ("팀원", "teammate"),
    ("teammate", "teammate"),
    ("사망", "death"),
    ("죽", "death"),
    ("death", "death"),
    ("움직", "movement"),
    ("이동", "movement"),
    ("movement", "movement"),
)


def normal_label(raw: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Known label of a spelling, else null."""
    key = F.lower(F.trim(raw))
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.try_element_at(known, key)


def resolved_label(raw: Column, path: Column, timestamp: Column) -> Column:
    """The label; a row with path and time but no label counts as ``multikill``."""
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    return F.when(~blank, normal_label(raw)).when((F.coalesce(path, F.lit("")) != "") & timestamp.isNotNull(), F.lit("multikill"))


def keyword_label(raw: Column, keywords: tuple[tuple[str, str], ...] = KEYWORDS) -> Column:
    """Label of the first keyword, in order of priority, in the part before a comma."""
    text = F.lower(F.trim(F.split(raw, ",")[0]))
    first, *rest = keywords
    return reduce(lambda case, k: case.when(text.contains(k[0]), k[1]), rest, F.when(text.contains(first[0]), first[1]))


def segment_id(path: Column, start: Column, end: Column, label: Column) -> Column:
    """Label and twelve digits of a digest of the segment."""
    digest = F.sha1(F.concat_ws("|", path, F.format_string("%.3f", start), F.format_string("%.3f", end), label).cast("binary"))
    return F.concat_ws("_", label, F.substring(digest, 1, 12))


def stable_split(key: Column, seed: int = 42, train: int = 80, val: int = 10) -> Column:
    """train / val / test by a digest of seed and key: reproducible in any order."""
    slot = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(slot < train, "train").when(slot < train + val, "val").otherwise("test")


def safe_stem(name: Column) -> Column:
    """File-name stem without spaces and characters that file systems refuse."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", "_"), r'[<>:"/\\|?*]', "_")
    return F.when(clean == "", "video").otherwise(clean)


def is_generated_clip(path: Column) -> Column:
    """Clip names that window extraction makes: a label and twelve hex digits."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(name).rlike(r"^(doublekill|multikill|save|allkill|background)_[a-f0-9]{12}\.mp4$")


def eligible(label: Column, path: Column, duration: Column, chunk_marker: str = "_chunks", limit: float = 90.0) -> Column:
    """Index rule: long recordings of the background class stay out, their chunks are
    always in, and so is one whose length is not known."""
    return (label != "background") | path.contains(chunk_marker) | F.coalesce(duration < limit, F.lit(True))
