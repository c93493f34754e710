"""Pseudonyms, date shifts, generalisation and scrubbing as column expressions (no UDF)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from wardlight.functions.rules import PHI_FIELDS, SCRUB


def _pads(key: bytes) -> tuple[str, str]:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of a string; the key is folded into two constants."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def hmac_sql(message: str, key: bytes) -> str:
    inner, outer = _pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def field_hash(value: Column, prefix: str, key: bytes) -> Column:
    clean = F.upper(F.trim(value))
    return F.when(F.coalesce(clean, F.lit("")) == "", "").otherwise(hmac_sha256(F.concat(F.lit(prefix + ":"), clean), key))


def pseudonym(identifier: Column, prefix: str, key: bytes) -> Column:
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(hmac_sha256(F.concat(identifier, F.lit(":" + prefix)), key), 1, 16)))


def shift_days(seed: Column, key: bytes) -> Column:
    return (F.conv(F.substring(hmac_sha256(seed, key), 1, 4), 16, 10).cast("int") % 181 - 90).cast("int")


def shift_date(text: Column, seed: Column, key: bytes) -> Column:
    """The date moved by the patient's shift; else its year; else a mark."""
    found = F.coalesce(*[F.try_to_date(text, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")])
    year = F.regexp_extract(text, r"\b(?:19|20)\d{2}\b", 0)
    return F.coalesce(F.date_format(F.date_add(found, shift_days(seed, key)), "yyyy-MM-dd"), F.when(year != "", year), F.lit("[DATE-REMOVED]"))


def generalize_age(age: Column) -> Column:
    return F.when(age > 89, "90+").otherwise(age.cast("string"))


def generalize_zip(zip_code: Column) -> Column:
    return F.when(F.length(zip_code) >= 5, F.concat(F.substring(zip_code, 1, 3), F.lit("000"))).otherwise("00000")


def without_fields(kind: DataType, value: Column, names: frozenset[str]) -> Column:
    """A value of nested structs and arrays without the named fields, at every depth; maps lose the keys of these names."""
    if isinstance(kind, StructType):
        kept = [without_fields(f.dataType, value[f.name], names).alias(f.name) for f in kind if f.name not in names]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
        return F.transform(value, lambda x: without_fields(kind.elementType, x, names))
    if isinstance(kind, MapType):
        kept = F.map_filter(value, lambda k, _: ~k.isin(*names))
        return F.transform_values(kept, lambda _, v: without_fields(kind.valueType, v, names)) if isinstance(kind.valueType, (StructType, ArrayType, MapType)) else kept
    return value


def drop_phi(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """rows without identifying fields (PHI_FIELDS), at the top and inside nested columns."""
    gone = frozenset(names or PHI_FIELDS)
    return rows.select(*[without_fields(f.dataType, F.col(f"`{f.name}`"), gone).alias(f.name) for f in rows.schema if f.name not in gone])


def encrypt(value: Column, key: bytes) -> Column:
    """AES-GCM under a 16, 24 or 32-byte key, base64: a random nonce of 12 bytes, cipher text and tag."""
    return F.base64(F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")))


def decrypt(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def scrub(text: Column) -> Column:
    for pattern, mark in SCRUB:
        text = F.regexp_replace(text, F.lit("(?i)" + pattern), F.lit(mark))
    return text


def scrub_sql(text: str) -> str:
    for pattern, mark in SCRUB:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'gi')"
    return text
