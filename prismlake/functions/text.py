"""Name and text expressions of the catalog, as Column builders."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a trailing counter is separators and digits, or digits in parentheses.
_COUNTER = r"(?:[\s_\-.]*+(?:\(\d++\)|\d++))"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def strip_extension(c: Column) -> Column:
    """Without an extension of up to five letters or digits."""
    return F.regexp_replace(c, r"^(.+)\.[\p{L}\p{N}]{1,5}$", "$1")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def clean_name(c: Column) -> Column:
    """No path separators or control characters, white space collapsed."""
    dashed = F.regexp_replace(c, r"[/:\p{Cc}]", "-")
    return F.trim(F.regexp_replace(dashed, r"\s+", " "))


def name_stem(c: Column) -> Column:
    """The name without trailing counters, however many; a name of counters alone keeps the first."""
    base = strip_extension(c)
    s = F.when(base.rlike(f"^{_COUNTER}++$"), F.regexp_extract(base, f"^({_COUNTER})", 1)).otherwise(F.regexp_replace(base, f"{_COUNTER}++$", ""))
    s = F.regexp_replace(s, r"^[ _\-.]+|[ _\-.]+$", "")
    return F.when(s == "", base).otherwise(s)


def display_name(title: Column, filename: Column, key: Column) -> Column:
    last = F.when(key.startswith("file:"), F.element_at(F.split(key, "/"), -1))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(filename, F.lit("")), last, F.lit("Untitled"))


def export_name(title: Column, filename: Column, asset_id: Column, is_video: Column) -> Column:
    """A cleaned title with the original's extension, else the original name, else a made one."""
    suffix = F.when(is_video, "mov").otherwise("jpg")
    ext = F.coalesce(F.nullif(extension(filename), F.lit("")), suffix)
    named = F.concat(strip_extension(clean_name(title)), F.lit("."), ext)
    return F.coalesce(F.when(F.coalesce(clean_name(title), F.lit("")) != "", named), F.nullif(filename, F.lit("")), F.concat(F.lit("Photo-"), asset_id.cast("string"), F.lit("."), suffix))


def padded(n: Column, width: int) -> Column:
    """Zero-padded; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def rename_pattern(pattern: str, name: Column, number: Column, at: Column, camera: Column, padding: int = 3) -> Column:
    """Tokens {name} {n} {date} {year} {month} {day} {time} {camera}, in any case; an empty result keeps the base name."""
    base = strip_extension(name)
    stamp = lambda f: F.coalesce(F.date_format(at, f), F.lit(""))
    values = {"n": padded(number, padding), "date": stamp("yyyy-MM-dd"), "year": stamp("yyyy"), "month": stamp("MM"), "day": stamp("dd"), "time": stamp("HH-mm-ss"), "camera": F.coalesce(camera, F.lit("")), "name": base}
    out: Column = F.lit(pattern)
    for token, value in values.items():
        literal = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        out = F.regexp_replace(out, F.lit(rf"(?i)\{{{token}\}}"), literal)
    out = clean_name(out)
    return F.when(out == "", base).otherwise(out)


def rename_replace(name: Column, find: str, to: str, case_sensitive: bool = False) -> Column:
    base = strip_extension(name)
    if not find:
        return base
    escaped = to.replace("\\", "\\\\").replace("$", "\\$")
    out = clean_name(F.regexp_replace(base, ("" if case_sensitive else "(?i)") + r"\Q" + find + r"\E", escaped))
    return F.when(out == "", base).otherwise(out)


def rename_affix(name: Column, prefix: str, suffix: str) -> Column:
    base = strip_extension(name)
    out = clean_name(F.concat(F.lit(prefix), base, F.lit(suffix)))
    return F.when(out == "", base).otherwise(out)


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def duration_text(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.round(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def query_terms(text: Column) -> Column:
    """Terms of a search text: split at white space and quotes, empty ones dropped."""
    return F.filter(F.split(text, r"[\s\"]+"), lambda t: t != "")


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters whose canonical decomposition is a letter and marks, and those letters."""
    marked, plain = [], []
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]) and len(parts[0]) == 1:
            marked.append(c)
            plain.append(parts[0])
    keep = [k for k, c in enumerate(marked) if ord(c) < 0x10000]  # translate() works on UTF-16 units
    return "".join(marked[k] for k in keep), "".join(plain[k] for k in keep)


def fold(c: Column) -> Column:
    """Lower-case, without diacritics, be they part of a letter or marks of their own."""
    marked, plain = _plain_letters()
    return F.regexp_replace(F.translate(F.lower(c), marked, plain), r"\p{Mn}", "")


def fold_text(text: str) -> str:
    """fold() of a search text."""
    return "".join(x for x in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(x) != "Mn")


def fold_tokens(text: Column) -> Column:
    """Lower-case words without diacritics, in order."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value, of any length: a run loses its leading zeros and is led by its length."""
    runs = F.split(F.regexp_replace(F.lower(c), r"(\d+)", "\u0001$1\u0001"), "\u0001")

    def value(r: Column) -> Column:
        digits = F.regexp_replace(r, r"^0+(?=\d)", "")
        return F.when(r.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(r)

    return F.array_join(F.transform(runs, value), "")


def exif_seconds(c: Column) -> Column:
    """Unix seconds of an EXIF date 'yyyy:MM:dd HH:mm:ss', null where it is none."""
    return F.unix_seconds(F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss")))
