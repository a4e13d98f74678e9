"""Variation-selector payloads: runs, decoding, entropy, classes, previews.

A byte b is carried by U+FE00 + b below 16 and by U+E0100 + b - 16 from 16 on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Character class of carriers.
CARRIER = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"


def encode_text(data: bytes) -> str:
    """The carriers of ``data``; used to plant payloads."""
    return "".join(chr(0xFE00 + b if b < 16 else 0xE0100 + b - 16) for b in data)


def carrier_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CARRIER}]"))


def decoded_hex(run: Column) -> Column:
    """The bytes of a run as hex digits; other characters are passed over."""
    carriers = F.regexp_extract_all(run, F.lit(f"[{CARRIER}]"), F.lit(0))
    byte = lambda c: F.lpad(F.hex(F.when(F.ascii(c) < 0x10000, F.ascii(c) - 0xFE00).otherwise(F.ascii(c) - 0xE0100 + 16)), 2, "0")
    return F.array_join(F.transform(carriers, byte), "")


def byte_entropy(data: Column) -> Column:
    """Shannon entropy in bits of the bytes; 0 for none.

    Bytes become characters, which are sorted once: each stretch of equal ones is
    a byte's count.  The time does not depend on how many distinct bytes there are.
    """

    def entropy(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * F.log2(k))
        n = F.aggregate(counts, F.lit(0.0), lambda s, k: s + k)
        return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))

    in_order = F.array_join(F.sort_array(F.split(F.decode(data, "ISO-8859-1"), "")), "")
    stretches = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return let(F.transform(stretches, lambda x: F.length(x).cast("double")), entropy)


def text_entropy(text: Column) -> Column:
    """Shannon entropy of the text's UTF-8 bytes."""
    return byte_entropy(text.cast("binary"))


def entropies(rows: DataFrame, key: list[str], data: Column) -> DataFrame:
    """(*key, entropy) per key: the entropy of its bytes, counted by tasks before the shuffle.

    At most 256 counts of a row reach the shuffle, whatever its size; ``byte_entropy``
    is the same within a row.
    """
    bytes_of = rows.select(*key, F.explode(F.split(F.decode(data, "ISO-8859-1"), "")).alias("_b"))
    counted = bytes_of.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    k = F.when(F.col("_b") != "", F.col("_n")).otherwise(0).cast("double")  # empty data give one empty byte
    summed = counted.groupBy(*key).agg(F.sum(k).alias("_k"), F.sum(F.when(k > 1, k * F.log2(k)).otherwise(0.0)).alias("_w"))
    return summed.select(*key, F.when(F.col("_k") > 0, F.log2("_k") - F.col("_w") / F.col("_k")).otherwise(F.lit(0.0)).alias("entropy"))


def payload_class(n_bytes: Column, entropy: Column, utf8: Column) -> Column:
    return (
        F.when(n_bytes < 16, "too_small")
        .when(entropy > 7, "encrypted_or_compressed")
        .when(entropy >= 6, "suspicious_data")
        .when(utf8, "plaintext_code")
        .otherwise("suspicious_data")
    )


#: What the classes mean.
CLASS_DESCRIPTIONS = {
    "plaintext_code": "readable text or code",
    "encrypted_or_compressed": "encrypted or compressed data",
    "suspicious_data": "data of unclear kind",
    "too_small": "too short to classify",
}


def decoded_payload(run: Column) -> Column:
    """struct(bytes, entropy, is_valid_utf8, decoded_text, payload_class, codepoint_count); null below four carriers."""

    def described(data: Column) -> Column:
        as_text = data.cast("string")
        utf8 = F.is_valid_utf8(as_text)
        return let(
            byte_entropy(data),
            lambda entropy: F.struct(
                data.alias("bytes"),
                entropy.alias("entropy"),
                utf8.alias("is_valid_utf8"),
                F.when(utf8, as_text).alias("decoded_text"),
                payload_class(F.octet_length(data), entropy, utf8).alias("payload_class"),
                carrier_count(run).cast("long").alias("codepoint_count"),
            ),
        )

    return F.when(carrier_count(run) >= 4, let(F.unhex(decoded_hex(run)), described))


def hex_preview(data: Column, most: int = 32) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.hex(F.substring(data, 1, most))), F.lit("(..)"), F.lit(1)), " ")


def text_preview(text: Column, most: int = 128) -> Column:
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("... ("), F.octet_length(text).cast("string"), F.lit(" bytes total)"))).otherwise(text)
