"""Text and identifier expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the scheme that link targets may carry.
TARGET_SCHEME = "bblocks://"


#: Combining marks that are dropped inside a word.
MARKS = (
    0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331,
)
#: Characters that are in no word: all but letters, numbers, private ones and those without an assignment.
_BETWEEN = r"[^\p{L}\p{N}\p{Co}\p{Cn}]+"


def _folded(c: str) -> str:
    """Case folding to one character, then the base letter where one mark stands on a letter of A-Z."""
    whole = c.casefold()
    if len(whole) != 1:
        whole = "".join(x for x in c.lower() if ord(x) not in MARKS)
    single = whole if len(whole) == 1 else c
    parts = unicodedata.normalize("NFD", single)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]) else single


@lru_cache(1)
def folding() -> dict[int, str | None]:
    """What becomes of each character that does not stay, by rule from Unicode's own tables; marks become nothing."""
    table: dict[int, str | None] = {c: f for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (f := _folded(chr(c))) != chr(c)}
    return table | dict.fromkeys(MARKS)


def fold(c: Column) -> Column:
    """Without case, and without accents where one stands on a Latin letter. One rule for texts and queries."""
    table = folding()
    kept = [(chr(k), v) for k, v in table.items() if v]
    source = "".join(k for k, _ in kept) + "".join(map(chr, MARKS))  # what has no counterpart is dropped
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), F.translate(c, source, "".join(v for _, v in kept))).otherwise(F.lower(c))


def spaced_tokens(c: Column) -> Column:
    """Folded words, each with a space on both sides, and one more space at either end.

    A phrase in the same form can then be found and counted as a plain string, inside generated code.
    The text is named once, so that it is worked through once.
    """
    return F.regexp_replace(fold(F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))), _BETWEEN, "  ")


def token_count(spaced: Column) -> Column:
    return (F.regexp_count(spaced, F.lit(" ")) / 2).cast("long") - 1


def join_filled(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def strip_scheme(c: Column) -> Column:
    return F.regexp_replace(c, f"^{TARGET_SCHEME}", "")


def org_of_register(c: Column) -> Column:
    """What stands before the first slash; null without one."""
    return F.when(F.contains(c, F.lit("/")), F.split(c, "/", 2)[0])


def host_of(url: Column) -> Column:
    """Authority of a URL with its port and credentials, null where there is none."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def row_id(key: Column) -> Column:
    """First eight bytes of the key's SHA-1, big-endian, top bit cleared."""
    digits = F.substring(F.sha1(key.cast("binary")), 1, 16)
    first = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(first.cast("string"), F.substring(digits, 2, 15)), 16, 10).cast("long")


def first_filled(*parts: Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def phrases_of(query: str) -> list[list[str]]:
    """A query's words, each as the tokens that must stand together. Words without a token are left out."""
    out = []
    for word in query.split():
        base = word.translate(folding())
        tokens = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Co", "Cn") else " " for c in base).split()
        if tokens:
            out.append(tokens)
    return out


def phrase_text(tokens: Iterable[str]) -> str:
    return "".join(f" {t} " for t in tokens)
