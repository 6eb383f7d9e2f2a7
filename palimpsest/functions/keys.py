"""Byte keys that sort as the values they encode, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_string(c: Column) -> Column:
    """Bytes with 00 escaped as 00FF and a final 0000, so that a component sorts before any that it begins."""
    pairs = F.regexp_replace(F.hex(c), "(..)", "$1 ")
    return F.unhex(F.concat(F.replace(F.replace(pairs, F.lit("00 "), F.lit("00FF ")), F.lit(" "), F.lit("")), F.lit("0000")))


def decode_string(c: Column) -> Column:
    """The bytes of an encoded string component that stands alone."""
    pairs = F.regexp_replace(F.regexp_replace(F.hex(c), "0000$", ""), "(..)", "$1 ")
    return F.unhex(F.replace(F.replace(pairs, F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit("")))


def split_string(c: Column) -> Column:
    """The first string component of a key: (value, rest, ok), rest being the bytes behind it. ok is false, and both are null, where the
    component does not end or a 00 stands before anything but FF. A null key gives null."""
    pairs = F.regexp_replace(F.hex(c), "(..)", "$1 ")
    at = F.instr(pairs, "00 00 ")  # pairs are whole, so this is where the component ends, if its escapes are sound
    head = F.substring(pairs, F.lit(1), at - 1)
    bare = lambda x: F.unhex(F.replace(x, F.lit(" "), F.lit("")))
    ok = (at > 0) & ~F.replace(head, F.lit("00 FF "), F.lit("")).contains("00 ")
    value, rest = bare(F.replace(head, F.lit("00 FF "), F.lit("00 "))), bare(F.substring(pairs, at + 6, F.length(pairs)))
    return F.when(c.isNotNull(), F.struct(F.when(ok, value).alias("value"), F.when(ok, rest).alias("rest"), ok.alias("ok")))


def split_double(c: Column) -> Column:
    """The number at the front of a key: (value, rest, ok); ok is false, and both are null, where there are fewer than eight bytes."""
    ok, top = F.octet_length(c) >= 8, -(1 << 63)
    bits = F.conv(F.hex(F.substring(c, 1, 8)), 16, -10).cast("long")
    bits = F.when(bits < 0, bits.bitwiseXOR(F.lit(top))).otherwise(F.bitwise_not(bits))
    value = F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")
    return F.when(c.isNotNull(), F.struct(F.when(ok, value).alias("value"), F.when(ok, F.substring(c, F.lit(9), F.octet_length(c))).alias("rest"), ok.alias("ok")))


def encode_double(c: Column) -> Column:
    """Eight bytes in the order of the numbers; -0 is 0. NaN is an error. The bits come by a Java call for each row, which is not compiled into
    the stage: SQL has no function for them."""
    c = F.when(F.isnan(c), F.raise_error(F.lit("NaN has no place in an order"))).otherwise(c + F.lit(0.0))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), c).cast("long")
    bits = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))
    return F.unhex(F.lpad(F.hex(bits), 16, "0"))


def prefix_end(c: Column) -> Column:
    """The least key above all keys that begin with c, null if there is none."""
    head = F.regexp_replace(F.hex(c), "(FF)+$", "")
    last = F.lpad(F.hex(F.conv(F.right(head, F.lit(2)), 16, 10).cast("int") + 1), 2, "0")
    return F.when(F.length(head) > 0, F.unhex(F.concat(F.substring(head, F.lit(1), F.length(head) - 2), last)))
