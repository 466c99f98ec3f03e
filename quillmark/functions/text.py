"""Text helpers as Column expressions, and the same on plain strings where a driver-side table needs them.

White space is Python's: besides ASCII it has the separators 0x1C to 0x1F, NBSP and the other Unicode spaces, so
every pattern spells the class out. Patterns with Unicode classes or case folding go through rx().
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import fixed

#: The inside of a character class, understood by Java, RE2 and (with \\uXXXX for \\x{XXXX}) Python.
WS = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = "[a-zа-я0-9]"
TOKEN = rf"{WORD}+(?:[.\-/]{WORD}+)*"

_FROM = "ё" + fixed.DASHES + "\r\n\t" + fixed.PUNCTUATION
_TO = "е" + "-" * len(fixed.DASHES) + " " * (3 + len(fixed.PUNCTUATION))
_TABLE = str.maketrans(_FROM, _TO)


def collapse(col: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(col, f"[{WS}]+", " "))


def strip(col: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col, rf"\A[{WS}]+|[{WS}]+\z", "")


def blank_to_null(col: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def normalize_search(col: Column) -> Column:
    return collapse(F.translate(F.lower(col), _FROM, _TO))


def normalize_content(col: Column) -> Column:
    """Lower-cased, ё as е, white space collapsed; punctuation stays."""
    return collapse(F.translate(F.lower(col), "ё", "е"))


def normalize_security(col: Column) -> Column:
    return collapse(F.translate(normalize_content(col), "|", " "))


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"({TOKEN})"), F.lit(1))


def phrase_pattern(phrase: Column) -> Column:
    return F.concat(F.lit(rf"(?<!{WORD})\Q"), phrase, F.lit(rf"\E(?!{WORD})"))


def phrase_position(text: Column, phrase: Column) -> Column:
    """Place (from 0) of the first occurrence with no word character around it, else -1."""
    return F.regexp_instr(text, phrase_pattern(phrase)) - 1


def rx(*patterns: str) -> str:
    """One pattern of alternatives, with Unicode classes and without regard to case."""
    return "(?iuU)" + "|".join(f"(?:{p})" for p in patterns)


def truncate(col: Column, most: int) -> Column:
    """At most so many characters, the last three of them dots where something was cut."""
    cut = F.concat(F.regexp_replace(F.substring(col, 1, most - 3), rf"[{WS}]+\z", ""), F.lit("..."))
    return F.when(F.length(col) <= most, col).otherwise(cut if most >= 4 else F.substring(col, 1, most))


def snippet_at(text: Column, position: Column, length: Column, most: int = 320) -> Column:
    """The text around a place of a normalised text."""
    half = max(40, most // 2)
    start = F.greatest(position - half, F.lit(0))
    return truncate(collapse(F.substring(text, start + 1, position + length + half - start)), most)


# --- the same for driver-side tables ---
def normalize_search_text(text: str) -> str:
    return " ".join(str(text).lower().translate(_TABLE).split())


def normalize_content_text(text: object) -> str:
    return " ".join(str(text).lower().replace("ё", "е").split())


def token_list(normalized: str) -> list[str]:
    return re.findall(TOKEN, normalized)
