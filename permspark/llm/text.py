"""Text rules that several operators share. Words end at ASCII white space only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Java pattern of the white space between words: space and the control characters 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters for trim and translate.
SPACE_CHARS = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Byte table: A-Z to a-z, everything else (also every byte of a longer character) as it is.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows apart whose ids are missing or repeated."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


KINDS = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
KINDS |= {f"array<{k}>": T.ArrayType(v) for k, v in KINDS.items()}


def row_type(fields: str) -> T.StructType:
    """Struct from "name kind, name kind"; needs no session, so that modules can declare their functions."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])
