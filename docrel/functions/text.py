"""Text functions: UTF-16 widths, clipping, emoji removal, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Emoji ranges that count as decoration, by first and last code point.
EMOJI_RANGES = (
    (0x1F1E0, 0x1F1FF),
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FAFF),
    (0xFE00, 0xFE0F),
    (0x200D, 0x200D),
)
EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"
#: Widths that a text column may have; beyond them MAX. An index key may not exceed KEY_WIDTH.
WIDTHS = (16, 32, 64, 128, 256, 450, 1000, 4000)
KEY_WIDTH = 450


def utf16_len(text: Column) -> Column:
    """UTF-16 code units (two for characters outside the basic plane)."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1).cast("long")


def clip_utf16(text: Column, units: int) -> Column:
    """The longest prefix of at most ``units`` code units; never half a surrogate pair."""
    whole = utf16_len(text)
    steps = F.aggregate(
        F.split(F.left(text, F.lit(units)), ""),
        F.struct(F.lit(0).cast("long").alias("units"), F.lit("").alias("out")),
        lambda acc, ch: F.struct(
            (acc["units"] + utf16_len(ch)).alias("units"), F.when(acc["units"] + utf16_len(ch) <= units, F.concat(acc["out"], ch)).otherwise(acc["out"]).alias("out")
        ),
        lambda acc: acc["out"],
    )
    return F.when(whole <= units, text).when(whole == F.length(text), F.left(text, F.lit(units))).otherwise(steps)


def strip_emoji(text: Column) -> Column:
    """Text without emoji; only where one was removed are runs of blanks closed up and the ends trimmed."""
    bare = F.regexp_replace(text, EMOJI, "")
    tidy = F.regexp_replace(F.regexp_replace(bare, "[ \\t]{2,}", " "), "^\\s+|\\s+$", "")
    return F.when(bare == text, text).otherwise(tidy)


def clean_text(value: Column, units: int | None = None) -> Column:
    bare = strip_emoji(value.cast("string"))
    return clip_utf16(bare, units) if units is not None else bare


def identifier(raw: Column) -> Column:
    """A SQL identifier: other characters become _, none at the end, never empty, never a digit first, 120 at most."""
    safe = F.regexp_replace(F.regexp_replace(raw, "[^0-9A-Za-z_]+", "_"), "_+$", "")
    named = F.when(safe == "", F.lit("col")).otherwise(safe)
    return F.left(F.when(named.rlike("^[0-9]"), F.concat(F.lit("c_"), named)).otherwise(named), F.lit(120))


def text_type(units: Column, headroom: float = 1.5) -> Column:
    """The declared type for texts of at most so many code units, with room to grow."""
    target = F.greatest(F.lit(1), F.ceil(units * F.lit(headroom)))
    out = F.when(target <= WIDTHS[0], f"NVARCHAR({WIDTHS[0]})")
    for width in WIDTHS[1:]:
        out = out.when(target <= width, f"NVARCHAR({width})")
    return out.otherwise("NVARCHAR(MAX)")
