"""Parsing, formatting and keys of ``<number>. <text>`` records as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The record's error message shows so many characters of the line.
SHOWN = 80


def trim_cr(line: Column) -> Column:
    """Without one trailing carriage return; any before it is data."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def separator(line: Column) -> Column:
    """1-based place of the first dot."""
    return F.instr(line, ".")


def has_separator(line: Column) -> Column:
    """A dot that isn't first, and a space right behind it."""
    dot = separator(line)
    return (dot > 1) & (F.substr(line, dot + 1, F.lit(1)) == " ")


def leading_number(line: Column) -> Column:
    """The signed 64-bit number that the part before the dot begins with; null if none fits.

    Most parts are a number and nothing else: a cast tells, where no white space is there for it to trim. Only other parts meet a regular expression.
    """
    before = F.substr(line, F.lit(1), separator(line) - 1)
    tight = (F.ascii(before) > 32) & (F.substr(line, separator(line) - 1, F.lit(1)) > " ")
    digits = F.regexp_extract(before, r"^[+-]?[0-9]+", 0)
    return F.coalesce(F.when(tight, before.try_cast("bigint")), F.nullif(digits, F.lit("")).try_cast("bigint"))


def whole_number(line: Column) -> Column:
    """The signed 64-bit number that the whole part before the first ``. `` is, white space around it allowed."""
    before = F.substr(line, F.lit(1), F.instr(line, ". ") - 1)
    return F.when(before.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.regexp_replace(before, r"\s+", " "))).try_cast("bigint")


def lenient_ok(line: Column) -> Column:
    return F.coalesce(has_separator(line) & leading_number(line).isNotNull(), F.lit(False))


def strict_ok(line: Column) -> Column:
    return F.coalesce((F.instr(line, ". ") > 1) & whole_number(line).isNotNull(), F.lit(False))


def text_of(line: Column, strict: bool = False) -> Column:
    """All behind the separator; bytes that aren't UTF-8 become U+FFFD before any order is taken."""
    at = F.instr(line, ". ") if strict else separator(line)
    return F.make_valid_utf8(F.substr(line, at + 2))


def text_offset(line: Column) -> Column:
    """0-based byte offset of the text; what precedes it is ASCII or the line is malformed."""
    return separator(line) + 1


def truncate_text(text: Column, most: int = SHOWN) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)


def format_line(number: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), text)


def digit_count(number: Column) -> Column:
    return F.length(number.cast("string"))


def line_bytes(number: Column, text: Column) -> Column:
    """Bytes of the formatted record with its newline."""
    return (digit_count(number) + 2 + F.octet_length(text) + 1).cast("bigint")


def capitalize_first(text: Column) -> Column:
    """Only the first letter changes."""
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def sort_key8(text: Column) -> Column:
    """The first 8 UTF-8 bytes, zero-padded, as 16 hex digits: ordered as unsigned keys are."""
    return F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 8)), 16, "0")


def shard_key2(text: Column) -> Column:
    """The first 2 UTF-8 bytes as an integer of 0 to 65535."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 2)), 4, "0"), 16, 10).cast("int")


def shard_id(key2: Column, shards: int) -> Column:
    """The one of ``shards`` equal ranges of the 16-bit key space that holds the key."""
    scaled = (key2.cast("bigint") + 1) * shards + 65535
    return (F.shiftright(scaled, 16) - 1).cast("int")


def size_format(size: Column) -> Column:
    """As options.format_size, with halves away from zero. Whole units and the rest are apart, so that no size of 64 bits overflows or meets a double."""
    gib, mib, kib = (F.lit(1 << p).cast("bigint") for p in (30, 20, 10))
    whole = lambda p: F.shiftright(size + F.lit(1 << p - 1).cast("bigint"), p).cast("string")
    tenths = F.shiftright(size.bitwiseAND(gib - 1) * 20 + gib, 31)  # 10 of the rest are one more
    return (
        F.when(size >= gib, F.concat((F.shiftright(size, 30) + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" GB")))
        .when(size >= mib, F.concat(whole(20), F.lit(" MB")))
        .when(size >= kib, F.concat(whole(10), F.lit(" KB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def size_parse(text: Column) -> Column:
    """As options.parse_size; null where that raises."""
    s = F.upper(F.trim(text))
    factor = F.when(s.endswith("KB"), 1 << 10).when(s.endswith("MB"), 1 << 20).when(s.endswith("GB"), 1 << 30)
    number = F.trim(F.substr(s, F.lit(1), F.length(s) - 2))
    valid = number.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    scaled = F.when(valid, number).try_cast("decimal(28,10)") * factor
    return F.when(factor.isNotNull(), scaled.cast("bigint")).otherwise(F.when(s.rlike(r"^[+-]?[0-9]+$"), s).try_cast("bigint"))
