"""Normalisation, hashes and metrics of recognised text, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F



@cache
def marked() -> tuple[str, str]:
    """Characters that are a letter with marks, then the marks; and the letters of the former: by Unicode's decompositions."""
    found, marks = {}, []
    for i in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        c = chr(i)
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
            continue
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))
        if base != c and len(base) == 1:
            found[c] = base
    return "".join(found) + "".join(marks), "".join(found.values())


def plain(c: Column | str) -> Column:
    """Whether a text has ASCII characters only, of which none is a carriage return: each is a character of its own."""
    return (F.octet_length(col(c)) == F.length(col(c))) & ~F.contains(col(c), F.lit("\r"))


def length(c: Column | str) -> Column:
    """Characters as a reader counts them: a letter with its marks, a flag, a line end are one each (extended grapheme clusters)."""
    return F.when(plain(c), F.length(col(c))).otherwise(F.regexp_count(col(c), F.lit(r"\X"))).cast("int")


def characters(text: str) -> list[str]:
    """The characters that length counts, of a plain string."""
    if text.isascii() and "\r" not in text:
        return list(text)
    import regex

    return regex.findall(r"\X", text)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space and newlines at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize(c: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed, letters are lower."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")))


def beginning(c: Column | str, n: int) -> Column:
    """The first n characters of normalize(c), of which no more is normalised than they and what can tell their case."""
    return F.substring(normalize(F.regexp_extract(col(c), rf"(?U)^\s*+(?:\S\s*+){{0,{n + 232}}}+", 0)), 1, n)


def sha(c: Column | str) -> Column:
    """T2"""
    return F.sha2(col(c), 256)


def text_hash(c: Column | str) -> Column:
    """T3"""
    return sha(normalize(c))


def frame_hash(width: Column, height: Column, bits_per_pixel: Column, bytes_per_row: Column, info: Column, pixels: Column) -> Column:
    """T4: hash of a frame's shape and its pixel bytes."""
    head = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), *(x for p in (bits_per_pixel, bytes_per_row, info) for x in (F.lit("|"), p.cast("string"))))
    return F.sha2(F.concat(head.cast("binary"), pixels), 256)


def display_frame_hash(display_id: Column, hashed: Column) -> Column:
    """T5: the same pixels on two displays differ."""
    return sha(F.concat(F.lit("display:"), display_id.cast("string"), F.lit("|frame:"), hashed))


def rounded(c: Column | str) -> Column:
    """Half away from zero, as text of an integer."""
    return F.round(col(c)).cast("long").cast("string")


def layout_hash(boxes: Column) -> Column:
    """T6. boxes: array of (y, x, w, h, text). Boxes whose y differ by at most half a pixel count as one row: y goes in rows
    of a pixel, which makes a total order of the pairwise rule."""
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(F.round(b.y).alias("row"), b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h"), normalize(b.text).alias("text"))))
    lines = F.transform(ordered, lambda b: F.concat_ws("|", b.text, rounded(b.x), rounded(b.y), rounded(b.w), rounded(b.h)))
    return sha(F.array_join(lines, "\n"))


def aggregate_hash(parts: Column) -> Column:
    """T7, T8. parts: array of (index, display_id, hash)."""
    return sha(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(F.lit("display:"), p.display_id.cast("string"), F.lit("|"), p.hash)), "\n"))


def fold(c: Column | str) -> Column:
    """Letters without marks, whether a mark is part of the character or follows it, in lower case."""
    return F.lower(F.when(F.octet_length(col(c)) == F.length(col(c)), col(c)).otherwise(F.translate(col(c), *marked())))


def normalized_words(c: Column | str) -> Column:
    """Marks folded, everything but letters and digits is a border."""
    spaced = F.regexp_replace(fold(c), r"[^\p{L}\p{M}\p{N}\s]", " ")
    return F.filter(F.split(spaced, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """T11"""
    return F.size(F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't over 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def normalized_bounds(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Shares of the frame, 0 where it has no area."""
    ok = (frame_w > 0) & (frame_h > 0)
    part = lambda v, of, name: F.when(ok, v / of).otherwise(F.lit(0.0)).alias(name)
    return F.struct(part(x, frame_w, "x"), part(y, frame_h, "y"), part(w, frame_w, "width"), part(h, frame_h, "height"))


def bounds_text(b: Column) -> Column:
    """T13, with labels."""
    return F.format_string("[x: %.4f, y: %.4f, w: %.4f, h: %.4f]", b["x"], b["y"], b["width"], b["height"])


def bounds_list(b: Column) -> Column:
    """T13, plain."""
    return F.format_string("[%.3f,%.3f,%.3f,%.3f]", b["x"], b["y"], b["width"], b["height"])


def recognized_text(blocks: Column, lines: Column, observations: Column) -> Column:
    """Blocks by blank lines, else lines, else observations. Each an array of texts in reading order."""
    some = lambda a, sep: F.when(F.size(a) > 0, F.array_join(a, sep))
    return F.coalesce(some(blocks, "\n\n"), some(lines, "\n"), some(observations, "\n"), F.lit(""))


def displays_text(displays: Column) -> Column:
    """T15. displays: array of (index, text); blank ones are left out."""
    shown = F.filter(F.array_sort(displays), lambda d: trimmed(d.text) != "")
    return F.array_join(F.transform(shown, lambda d: F.concat(F.lit("Display "), (d.index + 1).cast("string"), F.lit("\n"), d.text)), "\n\n")


def clock(seconds: Column | str) -> Column:
    """Mm:ss.cc"""
    hundredths = F.round(F.greatest(col(seconds), F.lit(0.0)) * 100).cast("long")
    return F.format_string("%02d:%02d.%02d", F.floor(hundredths / 6000), F.floor(hundredths / 100) % 60, hundredths % 100)


def clock_range(start: Column | str, end: Column | str) -> Column:
    return F.concat(clock(start), F.lit(" - "), clock(end))


def percent(share: Column | str) -> Column:
    return F.concat(F.round(col(share) * 100).cast("long").cast("string"), F.lit("%"))


def has_text(c: Column | str) -> Column:
    """T17"""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def timestamp_seconds(c: Column | str) -> Column:
    """HH:MM:SS,mmm as seconds, null if it isn't one."""
    p = F.split(col(c), ":")
    number = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, number(0) * 3600 + number(1) * 60 + F.regexp_replace(F.get(p, F.lit(2)), ",", ".").try_cast("double"))


def device_label(name: Column, maker: Column) -> Column:
    """S12"""
    return F.when((F.coalesce(maker, F.lit("")) != "") & ~F.contains(name, maker), F.concat(name, F.lit(" - "), maker)).otherwise(name)
