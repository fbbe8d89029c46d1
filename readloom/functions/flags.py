"""FLAG bits: parsing, formatting and predicates."""

from __future__ import annotations

import re
from enum import IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F


class Flag(IntFlag):
    PAIRED = 0x001
    PROPER_PAIRED = 0x002
    UNMAPPED = 0x004
    MATE_UNMAPPED = 0x008
    REVERSE_STRAND = 0x010
    MATE_REVERSE_STRAND = 0x020
    FIRST_IN_PAIR = 0x040
    SECOND_IN_PAIR = 0x080
    NONPRIMARY = 0x100
    QUALITY_FAILED = 0x200
    DUPLICATE = 0x400
    SUPPLEMENTARY = 0x800


# The letters of symbolic flags. f, F and _ stand for no bit.
LETTERS = {"p": 0x001, "P": 0x002, "u": 0x004, "U": 0x008, "r": 0x010, "R": 0x020, "1": 0x040, "2": 0x080, "s": 0x100, "q": 0x200, "x": 0x200, "d": 0x400, "S": 0x800, "f": 0, "F": 0, "_": 0}


#: What parse_flags() takes.
FLAG_FORM = "^(0[xX][0-9A-Fa-f]+|0[0-7]*|[1-9][0-9]*|[" + "".join(k for k in LETTERS if not k.isdigit()) + "][" + "".join(LETTERS) + "]*)?$"


class FormatError(ValueError):
    """Text that is not in the format that it should have."""


def parse_flags(text: str) -> int:
    """A number (decimal, 0… octal, 0x… hexadecimal) if it begins with a digit, else letters."""
    if text[:1].isdigit() and text.isascii():
        if not re.fullmatch(r"0[xX][0-9A-Fa-f]+|0[0-7]*|[1-9][0-9]*", text):
            raise FormatError(f"not a flag number: {text!r}")
        return int(text, 16) if text[:2] in ("0x", "0X") else int(text, 8 if text[0] == "0" else 10)
    value = 0
    for letter in text:
        if letter not in LETTERS:
            raise FormatError(f"not a flag letter: {letter!r}")
        value |= LETTERS[letter]
    return value


def parse_expression(*texts: str) -> tuple[int, int]:
    """(required, excluded) masks of expressions such as ``+pP-u``; they add up.

    ``f`` and ``F`` ask for a forward read or mate, which puts the reverse bit
    into the opposite mask; in a hexadecimal number they are digits.
    """
    masks = [0, 0]
    for text in texts:
        for sign, part in re.findall(r"([+-]?)([^+-]*)", text):
            side = int(sign == "-")
            masks[side] |= parse_flags(part)
            if not part[:1].isdigit():
                masks[1 - side] |= (0x10 if "f" in part else 0) | (0x20 if "F" in part else 0)
    return masks[0], masks[1]


def has_flags(flag: Column, required: int, excluded: int = 0) -> Column:
    return (flag.bitwiseAND(F.lit(required)) == required) & (flag.bitwiseAND(F.lit(excluded)) == 0)


def is_set(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(int(bit))) != 0


def parse_flags_column(text: Column) -> Column:
    """As parse_flags(); malformed text raises."""
    table = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k, v)])
    letters = F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: acc.bitwiseOR(F.coalesce(F.try_element_at(table, c), F.lit(0))))
    wrong = F.raise_error(F.concat(F.lit("not flags: "), text)).cast("int")
    return (
        F.when(text == "", 0)
        .when(text.rlike(r"^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(text, 3, 1 << 20), 16, 10).cast("int"))
        .when(text.rlike(r"^0[0-7]*$"), F.conv(text, 8, 10).cast("int"))
        .when(text.rlike(r"^[1-9][0-9]*$"), F.try_to_number(text, F.lit("9999999999")).cast("int"))
        .when(text.rlike(r"^[pPuUrRsqxdSfF_][pPuUrR12sqxdSfF_]*$"), letters)
        .otherwise(wrong)
    )


def flag_text(flag: Column) -> Column:
    """Symbolic flags; f and F show forward reads and mates that are mapped."""

    def mark(bit: Flag, letter: str) -> Column:
        return F.when(is_set(flag, bit), letter).otherwise("")

    own = F.when(is_set(flag, Flag.REVERSE_STRAND), "r").when(~is_set(flag, Flag.UNMAPPED), "f").otherwise("")
    mate_forward = is_set(flag, Flag.PAIRED) & ~is_set(flag, Flag.MATE_UNMAPPED)
    mate = F.when(is_set(flag, Flag.MATE_REVERSE_STRAND), "R").when(mate_forward, "F").otherwise("")
    return F.concat(
        mark(Flag.UNMAPPED, "u"), own, mark(Flag.MATE_UNMAPPED, "U"), mate, mark(Flag.PAIRED, "p"), mark(Flag.PROPER_PAIRED, "P"),
        mark(Flag.FIRST_IN_PAIR, "1"), mark(Flag.SECOND_IN_PAIR, "2"), mark(Flag.NONPRIMARY, "s"), mark(Flag.SUPPLEMENTARY, "S"),
        mark(Flag.QUALITY_FAILED, "x"), mark(Flag.DUPLICATE, "d"),
    )


def flag_hex(flag: Column) -> Column:
    return F.when(flag == 0, "0").otherwise(F.concat(F.lit("0x"), F.hex(flag)))


def flag_octal(flag: Column) -> Column:
    return F.when(flag == 0, "0").otherwise(F.concat(F.lit("0"), F.conv(flag.cast("string"), 10, 8)))


def format_flags(flag: Column, style: str = "dec") -> Column:
    return {"dec": lambda c: c.cast("string"), "oct": flag_octal, "hex": flag_hex, "text": flag_text}[style](flag)


def strand(flag: Column) -> Column:
    return F.when(is_set(flag, Flag.REVERSE_STRAND), -1).otherwise(1)


def strand_char(flag: Column) -> Column:
    return F.when(is_set(flag, Flag.REVERSE_STRAND), "-").otherwise("+")


def mate_strand(flag: Column) -> Column:
    return F.when(is_set(flag, Flag.MATE_REVERSE_STRAND), -1).otherwise(1)


def mate_strand_char(flag: Column) -> Column:
    return F.when(is_set(flag, Flag.MATE_REVERSE_STRAND), "-").otherwise("+")


def order(flag: Column) -> Column:
    """-1 for the first of a pair, +1 for the second, 0 if neither or both."""
    both = flag.bitwiseAND(F.lit(0xC0))
    return F.when(both == 0x40, -1).when(both == 0x80, 1).otherwise(0)
