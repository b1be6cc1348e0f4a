"""What a scanner's reading of a cell is cleaned and corrected by, and which values may enter a dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import filled, words

# Marks of a frame at a cell's ends; signs that a scanner reads for others; the longest code word; values and key words that are none; what a value of a column looks like; signs that are no noise, and shares of noise.
FRAME = ("|", "[", "]")
MISREAD, MEANT = "€£¢\u00a0ŒœÇç", "EEC 00Cc"
LONGEST_CODE = 12
NO_VALUES = ("", "NONE", "NONE NONE", "N/A", "NA", "-", "--", "0", "O", ".")
KEY_WORDS = ("NOM DU CABLE", "NO PLAN", "P.E.T", "M  T  I", "BORNE", "COULEUR", "SIGNAL", "JARRETIERES", "INDICE", "PAGE :", "EPEULE", "METROPOLE")
LOOKS = {"BORNE": r"^[A-Z0-9][A-Z0-9 \-]{0,14}$", "COULEUR": r"^[A-Z0-9][A-Z0-9 /+\-]{0,17}$", "SIGNAL": r"""^[A-Za-z0-9 .+\-/()'"/:_*#]{2,80}$""", "JARRETIERES": r"^[A-Za-z0-9][A-Za-z0-9 .+\-/()*#]{0,28}$"}
NOISE = r"""[\p{L}\p{N} .\-_/:+()'"]"""
MOST_NOISE, MOST_NOISE_PENDING = 0.3, 0.4


def common_signs(value: Column) -> Column:
    """Signs that are misread in any column: currency signs and ligatures, a degree sign beside a letter or digit, an l among digits."""
    out = F.translate(value, MISREAD, MEANT)
    for wrong, right in ((r"(?U)°(?=\w)", "0"), (r"(?U)(?<=\w)°", "0"), (r"(?<=\d)l(?=\d)", "1"), (r"(?U)(?<=\d)l\b", "1"), (r"(?U)\bl(?=\d)", "1")):
        out = F.regexp_replace(out, wrong, right)
    return out


def zeros_of_codes(word: Column) -> Column:
    """An O before or between digits of a short word with digits is a zero."""
    fixed = F.regexp_replace(F.regexp_replace(word, r"^[Oo](?=\d)", "0"), r"(?<=\d)[Oo](?=\d)", "0")
    return F.when((F.length(word) <= LONGEST_CODE) & F.rlike(word, F.lit(r"\d")), fixed).otherwise(word)


def clean_cell(value: Column) -> Column:
    """A cell without marks of the frame, with misread signs set right; empty without letters and digits, or where a sign is repeated five times."""
    out = F.trim(filled(value))
    for mark in FRAME:
        out = F.btrim(out, F.lit(mark))
    out = common_signs(F.trim(out))
    noise = ~F.rlike(out, F.lit(r"[\p{L}\p{N}]")) | F.rlike(out, F.lit(r"(.)\1{4,}"))
    return F.when(noise, "").otherwise(F.array_join(F.transform(words(out), zeros_of_codes), " "))


def nearest_word(value: Column, known: tuple[str, ...], most: int = 2) -> Column:
    """The word of a short list (the format's own) that a value in capitals is or lies nearest to, at ``most`` edits; the first of equally near ones, else the value."""
    asked = F.regexp_replace(common_signs(F.upper(filled(value))), "0", "O")
    near = F.array_min(F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(known)]), lambda x: F.struct(F.levenshtein(asked, x["w"]).alias("d"), x["k"].alias("k"), x["w"].alias("w"))))
    return F.when((filled(value) != "") & (near["d"] <= most), near["w"]).otherwise(value)


def leading_sign(value: Column, starts: tuple[str, ...], wrong: str = "4", right: str = "A") -> Column:
    """Words of three signs and more whose first sign is misread before a known beginning."""
    def fixed(w: Column) -> Column:
        meant = F.concat(F.lit(right), F.substring(w, 2, 1 << 20))
        known = F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(F.upper(meant), s))
        return F.when(F.startswith(w, F.lit(wrong)) & (F.length(w) >= 3) & known, meant).otherwise(w)

    return F.array_join(F.transform(words(value), fixed), " ")


def _few_noise(value: Column, share: float) -> Column:
    return F.length(F.regexp_replace(value, NOISE, "")) <= F.greatest(F.lit(1.0), share * F.length(value))


def may_be_known(column: Column, value: Column) -> Column:
    """Whether a value may enter the final dictionary of its column."""
    v = F.trim(filled(value))
    key = F.exists(F.array(*map(F.lit, KEY_WORDS)), lambda k: F.contains(F.upper(v), k))
    looks = F.length(v) >= 2
    for name, pattern in LOOKS.items():
        looks = F.when(F.upper(column) == name, F.rlike(v, F.lit(pattern))).otherwise(looks)
    return ~F.upper(v).isin(*NO_VALUES) & ~key & _few_noise(v, MOST_NOISE) & looks


def may_be_pending(value: Column) -> Column:
    """Whether a value may wait for review."""
    v = F.trim(filled(value))
    return ~F.upper(v).isin(*NO_VALUES) & _few_noise(v, MOST_NOISE_PENDING)
