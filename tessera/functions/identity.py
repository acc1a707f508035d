"""Deterministic identities: padded keys, content hashes, observation keys, keyed hashes and buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

OBSERVATION_FIELDS = ("cik", "taxonomy", "concept", "unit", "start_date", "end_date", "filed_date", "fiscal_year", "fiscal_period", "form_type", "accession_number")


def zero_padded(value: Column, width: int) -> Column:
    """The value left-padded with zeros; longer values stay whole (``lpad`` alone would cut them)."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def normalized_cik(value: Column) -> Column:
    """Ten digits, or null where the trimmed value is not one to ten ASCII digits."""
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(text.rlike("^[0-9]{1,10}$"), F.lpad(text, 10, "0"))


def observation_key(fields: tuple[str, ...] = OBSERVATION_FIELDS) -> Column:
    """SHA-256 over the fields joined by bars, nulls as empty strings; the value is no part of it."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)


def unit_hash(secret: str, experiment: str, salt: str, unit: Column) -> Column:
    """Hex HMAC-SHA-256 of ``experiment:salt:unit`` from built-in hashes."""
    if len(secret) < 32:
        raise ValueError("the secret needs 32 characters at least")
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ x for b in key) for x in (0x36, 0x5C))
    message = F.concat(F.lit(f"{experiment}:{salt}:"), F.trim(unit)).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def bucket(fingerprint: str, unit: Column, size: int = 10_000) -> Column:
    """The first 64 bits of SHA-256(``fingerprint:unit``), unsigned, modulo ``size``."""
    digest = F.sha2(F.concat(F.lit(f"{fingerprint}:"), unit), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % size).cast("int")
