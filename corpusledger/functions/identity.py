"""Identifiers, hashes, timestamps, paths and cursors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
HASH_PATTERN = r"^[a-z0-9-]+:[0-9a-f]{32,128}$"
SOURCE_PATTERN = r"(?i)^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
SUFFIX = {"none": ".bin", "zstd": ".bin.zst", "gzip": ".bin.gz"}
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CURSOR_PREFIX = "v1:"


def document_id(source: Column, native: Column) -> Column:
    """SHA-256 of source and native id around a unit separator; null if the native id is empty or holds one."""
    native = native.cast("string")
    ok = (F.length(native) > 0) & ~native.contains(SEPARATOR)
    return F.when(ok, F.sha2(F.concat(source, F.lit(SEPARATOR), native).cast("binary"), 256))


def valid_source(source: Column) -> Column:
    return source.rlike(SOURCE_PATTERN)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def valid_hash(value: Column) -> Column:
    return value.rlike(HASH_PATTERN)


def hash_algorithm(value: Column) -> Column:
    return F.substring_index(value, ":", 1)


def hash_hex(value: Column) -> Column:
    return F.substring_index(value, ":", -1)


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def parse_iso(text: Column) -> Column:
    """A timestamp, null where the text is not one."""
    return F.try_to_timestamp(text)


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def file_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def shard_path(value: Column, compression: Column) -> Column:
    """objects/ab/cd/<hex><suffix>."""
    digits, suffix = hash_hex(value), F.lit(SUFFIX["none"])
    for kind, end in SUFFIX.items():
        suffix = F.when(compression == kind, F.lit(end)).otherwise(suffix)
    return F.concat(F.concat_ws("/", F.lit("objects"), F.substring(digits, 1, 2), F.substring(digits, 3, 2), digits), suffix)


def descriptor_path(value: Column) -> Column:
    digits = hash_hex(value)
    return F.concat(F.concat_ws("/", F.lit("objects"), F.substring(digits, 1, 2), F.substring(digits, 3, 2), digits), F.lit(".json"))


def ulid_time(millis: Column) -> Column:
    """The 10 Crockford digits of a ULID's time part."""
    digits = [F.substring(F.lit(CROCKFORD), (F.pmod(F.shiftright(millis, 5 * i), F.lit(32)) + 1).cast("int"), F.lit(1)) for i in range(9, -1, -1)]
    return F.concat(*digits)


def surrogate_ulid(millis: Column, *keys: Column) -> Column:
    """A ULID whose random part is the hash of the row's keys: sortable by time, equal on every rerun."""
    digest = F.sha2(F.concat_ws(SEPARATOR, *[k.cast("string") for k in keys]).cast("binary"), 256)
    parts = [F.substring(F.lit(CROCKFORD), (F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("int") % 32 + 1).cast("int"), F.lit(1)) for i in range(16)]
    return F.concat(ulid_time(millis), *parts)


def encode_cursor(key: Column) -> Column:
    body = F.base64(F.concat(F.lit(CURSOR_PREFIX), key.cast("string")).cast("binary"))
    return F.rtrim(F.translate(body, "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """The key in a cursor; null if its prefix is not known."""
    padded = F.concat(F.translate(cursor, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(cursor), F.lit(4))))
    text = F.decode(F.unbase64(padded), "UTF-8")
    return F.when(text.startswith(CURSOR_PREFIX), F.substring(text, F.lit(len(CURSOR_PREFIX) + 1), F.length(text)))


def checksum(text: Column) -> Column:
    """Checksum of a script, the same for either line ending."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)
