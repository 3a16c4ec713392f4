"""Unicode-aware string expressions that behave like Python's ``str`` methods.

Spark's ``trim`` strips only the space character and Java's ``\\s`` is ASCII
unless ``(?U)`` is set, while the reference relies on Python's Unicode-aware
``str.strip()`` / ``str.split()``.  The classes below are *generated from a
rule* (Python's own ``str.isspace`` / ``unicodedata``) so that both Spark and the
DuckDB oracle can use the very same explicit character class.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _char_class(codepoints) -> str:
    parts = []
    cps = sorted(codepoints)
    i = 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        if j == i:
            parts.append("\\x{%X}" % cps[i])
        else:
            parts.append("\\x{%X}-\\x{%X}" % (cps[i], cps[j]))
        i = j + 1
    return "".join(parts)


# Whitespace exactly as Python's str.isspace() sees it (rule-generated).
WHITESPACE_CODEPOINTS = tuple(c for c in range(sys.maxunicode + 1) if chr(c).isspace())
WS = _char_class(WHITESPACE_CODEPOINTS)
WS_CLASS = "[" + WS + "]"
NON_WS_RUN = "[^" + WS + "]+"
EDGE_WS = "^[" + WS + "]+|[" + WS + "]+$"

# A "word character" the way Python's Unicode \w sees letters, digits and '_'.
WORD_RUN_2 = "[\\p{L}\\p{N}_]{2,}"


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), EDGE_WS, "")


def word_count(c) -> Column:
    """``len(str.split())``: number of whitespace-separated tokens."""
    return F.regexp_count(_col(c), F.lit(NON_WS_RUN))


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition (NFKD) without combining marks makes of each character:
    ``translate``'s two strings for characters that become one character or none, and a
    table of those that become several (rule-generated from ``unicodedata``).

    The marks' order among each other does not matter once they are gone, so a text's
    decomposition is that of its characters.  Hangul syllables stay whole (an equal syllable
    is an equal syllable either way)."""
    one, none, several = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if d == ch:
            continue
        if not d:
            none.append(ch)
        elif len(d) == 1:
            one.append((ch, d))
        else:
            several[ch] = d
    return "".join(c for c, _ in one) + "".join(none), "".join(d for _, d in one), several


def strip_accents(c) -> Column:
    """NFKD without combining marks (``é`` → ``e``, ``ﬁ`` → ``fi``, ``Ａ`` → ``A``), JVM-side: one
    ``translate`` for characters that become one or none; the pieces around and of the others are
    looked up in a table, in texts that have any."""
    src, dst, several = decompositions()
    inside = _char_class(map(ord, several))
    table = F.str_to_map(F.lit("\ue000".join(f"{k}\ue001{v}" for k, v in several.items())), F.lit("\ue000"), F.lit("\ue001"))
    plain = F.translate(_col(c), src, dst)
    # a class of many ranges is tried range by range on every character, so it only meets texts that
    # hold one of its characters, which the table of ``translate`` finds, and in them no ASCII character
    inside = f"[^\\x00-\\x7F]&&[{inside}]"
    pieces = F.regexp_extract_all(plain, F.lit(f"[{inside}]|[^{inside}]+"), F.lit(0))
    expanded = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    held = F.length(F.translate(plain, "".join(several), "")) < F.length(plain)
    return F.when(held, expanded).otherwise(plain)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
