"""Text functions as column expressions.

All take a column and give a column; null reads as the empty string unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented capitals and what they are compared as; marks that are dropped; signs that scanners confuse.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYY"
DROPPED = "[|!'‘’`\"_;:]"
CONFUSED = "OILS7BZ,"
CONFUSED_AS = "0115T82."
LIGHT = "OIl"
LIGHT_AS = "011"
SPACE = r"(?U)\s+"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(filled(c), SPACE, " "))


def compact(c: Column) -> Column:
    """Without white space, in capitals."""
    return F.upper(without_space(c))


def without_space(c: Column) -> Column:
    return F.regexp_replace(filled(c), SPACE, "")


def plain(c: Column) -> Column:
    """In capitals without accents; ß becomes SS."""
    return F.translate(F.upper(filled(c)), ACCENTED, PLAIN)


def normalise(c: Column) -> Column:
    """What two readings are compared by: no accents, capitals, no white space, no frame marks."""
    return F.regexp_replace(F.regexp_replace(plain(c), SPACE, ""), DROPPED, "")


def fold(c: Column) -> Column:
    """``normalise``, with signs that scanners confuse made equal."""
    return F.translate(normalise(c), CONFUSED, CONFUSED_AS)


def light_fold(c: Column) -> Column:
    return F.upper(F.translate(filled(c), LIGHT, LIGHT_AS))


def words(c: Column) -> Column:
    """array<string> of the words between white space."""
    return F.filter(F.split(filled(c), SPACE, -1), lambda w: w != "")


def forms(c: Column) -> Column:
    """array<string> of runs of two letters or digits and more, in capitals, in order."""
    return F.regexp_extract_all(F.upper(filled(c)), F.lit("[A-Z0-9]{2,}"), F.lit(0))


def without_repeats(c: Column, most: int = 4) -> Column:
    """A sign repeated more than ``most`` times stands once (rows of dots or dashes left by a scanner)."""
    return F.regexp_replace(filled(c), rf"(.)\1{{{most},}}", "$1")


def noise_share(c: Column) -> Column:
    """Share of characters that are no letter, digit or blank; 0 for the empty string."""
    n = F.length(filled(c))
    return F.when(n > 0, F.length(F.regexp_replace(filled(c), r"[\p{L}\p{N} ]", "")) / n).otherwise(F.lit(0.0))


def page_key(c: Column) -> Column:
    """struct<number, suffix> of a page label's last number with an optional letter; null without one. Structs compare as the pair does."""
    at = r"(\d+)\s*([a-z]?)\s*$"
    low = F.lower(filled(c))
    return F.when(F.regexp_extract(low, at, 1) != "", F.struct(F.regexp_extract(low, at, 1).cast("int").alias("number"), F.regexp_extract(low, at, 2).alias("suffix")))


def numbered(c: Column) -> Column:
    """struct<prefix, number>: the number that the last word starts with, and the words before it as the code (RM 11B is RM and 11); null when the last word is no number."""
    ws = words(c)
    last = F.element_at(F.concat(F.array(F.lit("")), ws), -1)
    digits = F.regexp_extract(last, r"^(\d+)[A-Za-z]?$", 1)
    return F.when(digits != "", F.struct(F.array_join(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), " ").alias("prefix"), digits.cast("int").alias("number")))


def duration(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long"), s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", hours, (minutes % 60).cast("long"), rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def remaining(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


def progress(message: Column) -> Column:
    """struct<page, total> of 'Page n/total' in a message; null without it."""
    at = r"(?i)page\s+(\d+)\s*/\s*(\d+)"
    n = F.regexp_extract(filled(message), at, 1)
    return F.when(n != "", F.struct(n.cast("int").alias("page"), F.regexp_extract(filled(message), at, 2).cast("int").alias("total")))


def template(pattern: str, fields: Column) -> Column:
    """Fill {name} in a fixed pattern from a map; missing names give ''."""
    import re

    out: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", pattern):
        out += [F.lit(pattern[at : m.start()]), filled(F.try_element_at(fields, F.lit(m[1])))]
        at = m.end()
    return F.concat(*out, F.lit(pattern[at:]))


def placed(text: Column, starts: Column) -> Column:
    """The words of ``text`` set at character columns (array<int>), with one blank between at least."""
    pairs = F.arrays_zip(words(text).alias("w"), starts.alias("s"))
    return F.aggregate(
        pairs,
        F.lit(""),
        lambda acc, p: F.when(p["w"].isNull(), acc).otherwise(F.concat(F.rpad(acc, F.greatest(F.coalesce(p["s"], F.lit(0)), F.when(acc == "", F.lit(0)).otherwise(F.length(acc) + 1)), F.lit(" ")), p["w"])),
    )


def starts(text: Column, origin: Column | int = 0) -> Column:
    """array<int> of the character columns at which the words of ``text`` start, from ``origin`` on."""
    origin = F.lit(origin) if isinstance(origin, int) else origin
    pieces = F.split(filled(text), r"(?U)\S+", -1)
    ws = words(text)
    return F.transform(ws, lambda w, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(ws, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) - origin)


def luminance(rgb: Column) -> Column:
    """Relative luminance of a colour written as RRGGBB."""

    def part(at: int) -> Column:
        v = F.conv(F.substring(rgb, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * part(1) + 0.7152 * part(3) + 0.0722 * part(5)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def content_key(*parts: Column) -> Column:
    """sha-256 of parts; what a cache of readings is keyed by."""
    return F.sha2(F.concat_ws("\x1f", *[filled(p) for p in parts]), 256)
