"""Literal cases of the scalar functions."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusledger.functions import content, decisions, identity, text
from corpusledger.operators.query import from_cursor, to_cursor


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_document_ids_keep_their_parts_apart(spark):
    got = one(spark, a=identity.document_id(F.lit("ab"), F.lit("c")), b=identity.document_id(F.lit("a"), F.lit("bc")), c=identity.document_id(F.lit("a"), F.lit("")), d=identity.document_id(F.lit("a"), F.lit("x\x1fy")))
    assert got["a"] == hashlib.sha256(b"ab\x1fc").hexdigest() != got["b"]
    assert got["c"] is None and got["d"] is None


def test_hashes_and_paths(spark):
    h = identity.content_hash(F.lit("x"))
    got = one(spark, h=h, ok=identity.valid_hash(h), bad=identity.valid_hash(F.lit("sha256:XY")), alg=identity.hash_algorithm(h), path=identity.shard_path(h, F.lit("zstd")), d=identity.descriptor_path(h), s=identity.valid_source(F.lit("bj.a-1")), t=identity.valid_source(F.lit("-a")))
    digits = hashlib.sha256(b"x").hexdigest()
    assert got == {"h": f"sha256:{digits}", "ok": True, "bad": False, "alg": "sha256", "path": f"objects/{digits[:2]}/{digits[2:4]}/{digits}.bin.zst", "d": f"objects/{digits[:2]}/{digits[2:4]}/{digits}.json", "s": True, "t": False}


def test_cursor_round_trip(spark):
    key = "d1??>é"
    got = one(spark, c=identity.encode_cursor(F.lit(key)), back=identity.decode_cursor(F.lit(to_cursor(key))), bad=identity.decode_cursor(F.lit("eDE6YQ")))
    assert got["c"] == to_cursor(key) and from_cursor(got["c"]) == key == got["back"] and got["bad"] is None
    with pytest.raises(ValueError):
        from_cursor("eDE6YQ")


def test_surrogate_ulid_sorts_by_time(spark):
    a, b = (identity.surrogate_ulid(F.lit(ms), F.lit("k")) for ms in (1_700_000_000_000, 1_700_000_000_001))
    got = one(spark, a=a, b=b)
    assert len(got["a"]) == 26 and got["a"] < got["b"] and got["a"][:10] == "01HF7YAT00"


def test_checksum_ignores_line_ends(spark):
    got = one(spark, a=identity.checksum(F.lit("a\r\nb")), b=identity.checksum(F.lit("a\nb")))
    assert got["a"] == got["b"]


@pytest.mark.parametrize(
    ("body", "mime"),
    [
        (b"%PDF-1.7\n", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"\x1f\x8b\x08", "application/gzip"),
        (b"\0" * 257 + b"ustar", "application/x-tar"), (b"  <!DOCTYPE HTML><p>", "text/html"), (b"<?xml version='1.0'?>", "application/xml"), (b' {"a": 1}', "application/json"), (b"plain text", "text/plain"), (b"", None), (b"a\x00bcdefg", None), (b"\xff\xfe\xfa\xfb\xfc", None),
    ],
)
def test_mime_sniffing(spark, body, mime):
    df = spark.createDataFrame([(bytearray(body),)], "b binary")
    assert df.select(content.sniff_mime(F.col("b"))).first()[0] == mime


def test_compressible_and_types(spark):
    got = one(spark, a=content.compressible(F.lit("Text/HTML; charset=x"), F.lit(5000)), b=content.compressible(F.lit("text/html"), F.lit(4095)), c=content.compressible(F.lit("application/pdf"), F.lit(9000)), d=content.compressible(F.lit("application/ld+json"), F.lit(4096)), e=content.bare_type(F.lit("text/html ; q=1")))
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": "text/html"}


def test_expectations(spark):
    v = lambda **k: content.violation(F.lit(b"%PDF-1"), F.lit(6), F.lit("application/pdf; x=y"), F.lit("text/plain"), **k)
    got = one(spark, ok=v(min_bytes=1, max_bytes=9, magic="25504446", mime_types=["application/pdf"]), small=v(min_bytes=7), large=v(max_bytes=5), magic=v(magic="00"), mime=v(mime_types=["image/png"]))
    assert got == {"ok": None, "small": "too_small", "large": "too_large", "magic": "magic", "mime": "mime"}
    both = content.intersect_expectations({"mime_types": F.array(F.lit("a"), F.lit("b")), "min_bytes": F.lit(1), "magic": F.lit("aa")}, {"mime_types": F.array(F.lit("b")), "min_bytes": F.lit(5), "max_bytes": F.lit(9), "magic": F.lit("bb")})
    assert one(spark, **both) == {"mime_types": ["b"], "min_bytes": 5, "max_bytes": 9, "magic": "bb"}


def test_dates_and_sizes(spark):
    got = one(spark, d=text.published_date(F.lit("Publié le 27.07.2026")), none=text.published_date(F.lit("27.07.2026")), k=text.declared_size(F.lit("430 Ko")), m=text.declared_size(F.lit("1,5 Mo")), o=text.declared_size(F.lit("12 o")))
    assert got == {"d": "2026-07-27", "none": None, "k": 440320, "m": 1572864, "o": 12}


def test_entities_and_tags(spark):
    got = one(spark, a=text.decode_entities(F.lit("a &amp;lt; &#233;&#128512; &#x41; &apos;")), b=text.strip_tags(F.lit("<p> a\n <b>b</b>&nbsp;c</p>")), c=text.strip_tags(F.lit("<br>")))
    assert got == {"a": "a &lt; é😀 &#x41; '", "b": "a b c", "c": None}


def test_links(spark):
    page = F.lit("http://h:8/a/b?x=1#f")
    got = one(spark, i=text.stable_id(F.lit("/x/documents/2024-118/?s=1")), a=text.absolute_url(F.lit("/d"), page), b=text.absolute_url(F.lit("d"), page), c=text.absolute_url(F.lit("//o/p"), page), d=text.absolute_url(F.lit("https://z/"), page), e=text.absolute_url(F.lit("?q"), page), h=text.url_host(page), p=text.url_path(page))
    assert got == {"i": "2024-118", "a": "http://h:8/d", "b": "http://h:8/a/d", "c": "http://o/p", "d": "https://z/", "e": "http://h:8/a/b?q", "h": "h:8", "p": "/a/b?x=1"}
    assert one(spark, y=text.host_allowed(page, ["H:8"]), n=text.host_allowed(F.lit("ftp://h:8/"), ["h:8"])) == {"y": True, "n": False}


def test_json_and_redaction(spark):
    got = one(spark, c=text.canonical_json(F.lit('{ "b": 1.50, "a": "é" }')), r=text.redact(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("n"), F.lit("1"))))
    assert got == {"c": '{"a":"é","b":1.5}', "r": {"api_key": "[redacted]", "n": "1"}}


def test_backoff_and_retry(spark):
    rows = spark.range(1, 6).select(decisions.backoff_ms(F.col("id")).alias("ms")).collect()
    assert [r.ms for r in rows] == [0, 1000, 4000, 16000, 64000]
    now = F.lit(datetime(2026, 1, 1))
    got = one(spark, s=decisions.retry_after_ms(F.lit("7"), now), d=decisions.retry_after_ms(F.lit("Thu, 01 Jan 2026 00:00:05 GMT"), now), n=decisions.retry_after_ms(F.lit("soon"), now), y=decisions.retryable_status(F.lit(503)), z=decisions.retryable_status(F.lit(404)))
    assert got == {"s": 7000, "d": 5000, "n": None, "y": True, "z": False}


def test_freshness_and_errors(spark):
    n = F.lit(None).cast("string")
    f = decisions.freshness
    t, u = F.lit("t"), F.lit("u")
    got = one(spark, a=f(t, t, n, n, F.lit(False)), b=f(t, u, t, t, F.lit(True)), c=f(n, t, t, t, F.lit(True)), d=f(n, n, n, n, F.lit(True)), e=f(n, n, n, n, F.lit(False)), x=decisions.network_error(F.lit("Delai depasse")), y=decisions.verify_status(F.lit("size_mismatch")))
    assert got == {"a": "etag_match", "b": "changed", "c": "not_modified", "d": "incremental_skip", "e": "changed", "x": "NetworkTimeout", "y": "corrupt"}


def test_formats(spark):
    got = one(spark, a=content.format_bytes(F.lit(512)), b=content.format_bytes(F.lit(1536)), c=content.format_duration(F.lit(999)), d=content.format_duration(F.lit(61_000)), e=content.format_duration(F.lit(3_660_000)), v=decisions.semver(F.lit("1.20.3-rc1")))
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == ("512 o", "1.50 Kio", "999 ms", "1 min 01 s", "1 h 01 min")
    assert tuple(got["v"]) == (1, 20, 3)
