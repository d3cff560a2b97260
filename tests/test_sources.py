"""Sources, sinks and streaming end to end in temporary folders."""

import gzip
import hashlib
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusledger.operators import integrity
from corpusledger.sources import journal, paged, registry, store
from corpusledger.streaming import intake


def put(root, body: bytes, compression="none", damage=None, keep=True, tombstone=False):
    digits = hashlib.sha256(body).hexdigest()
    folder = root / "objects" / digits[:2] / digits[2:4]
    folder.mkdir(parents=True, exist_ok=True)
    packed = {"none": body, "gzip": gzip.compress(body), "zstd": zstandard.ZstdCompressor().compress(body)}[compression]
    suffix = {"none": ".bin", "gzip": ".bin.gz", "zstd": ".bin.zst"}[compression]
    if keep:
        (folder / f"{digits}{suffix}").write_bytes(damage if damage is not None else packed)
    refs = [{"documentId": "d1", "sourceId": "s", "nativeId": "n", "versionNo": 1, "fetchedAt": "2026-01-01T00:00:00.000Z"}, {"documentId": "d2", "sourceId": "t", "nativeId": "m", "versionNo": 3, "fetchedAt": "2026-01-02T00:00:00.000Z"}]
    body_ = {"contentHash": f"sha256:{digits}", "byteSize": len(body), "compression": compression, "references": refs}
    (folder / f"{digits}.json").write_text(json.dumps(body_ | ({"tombstone": True} if tombstone else {}), indent=2))
    return f"sha256:{digits}"


def test_store(spark, tmp_path):
    ok = [put(tmp_path, b"one"), put(tmp_path, b"two" * 999, "zstd"), put(tmp_path, b"three", "gzip"), put(tmp_path, b"gone", keep=False, tombstone=True)]
    bad = {put(tmp_path, b"x1", keep=False): "missing_file", put(tmp_path, b"x2", "zstd", damage=b"junk"): "unreadable", put(tmp_path, b"x3", damage=b"longer"): "size_mismatch", put(tmp_path, b"x4", damage=b"4x"): "hash_mismatch"}
    got = {r.content_hash: r.result for r in store.verify_store(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(ok, "ok") | bad
    found = store.scan(spark, str(tmp_path))
    report = integrity.rebuild_report(found).first().asDict()
    assert report == {"objects": 7, "versions": 14, "tombstones": 1, "missing_bytes": 1}
    rebuilt = {r.document_id: (r.current_version, r.version_count) for r in integrity.rebuild_documents(store.references(found)).collect()}
    assert rebuilt == {"d1": (1, 1), "d2": (3, 1)}


def test_malformed_descriptor_stops_the_scan(spark, tmp_path):
    put(tmp_path, b"one")
    (tmp_path / "objects" / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        store.descriptors(spark, str(tmp_path)).collect()


def test_journal(spark, tmp_path):
    rows = [("1", str(i), "corpus.run.started", "/sources/a", f"2026-01-{i:02}T00:00:00.000Z", "r", "{}") for i in range(1, 11)]
    journal.write(spark.createDataFrame(rows, journal.EVENT), str(tmp_path / "j"))
    with (next((tmp_path / "j" / "day=2026-01-10").glob("*.json"))).open("a") as f:
        f.write("{broken\n")
    for crc in (tmp_path / "j").rglob(".*.crc"):
        crc.unlink()
    assert sorted(int(r.id) for r in journal.read(spark, str(tmp_path / "j")).collect()) == list(range(4, 11))
    assert [r.id for r in journal.ring(journal.read(spark, str(tmp_path / "j"), None), 2).collect()] == ["9", "10"]


def test_paged_index(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page-{i}.html").write_text(f"<p>{i}")
    paged.register(spark)
    read = lambda **o: sorted(r.page for r in spark.read.format("paged_index").options(path=str(tmp_path), **o).load().collect())
    assert read() == [0, 1, 2] and read(resume="page:1") == [1, 2] and read(maxPages="2") == [0, 1]


def test_paged_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paged.register(spark)

    def go():
        stream = spark.readStream.format("paged_index").option("path", str(tmp_path / "in")).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.page for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "page-0.html").write_text("a")
    assert go() == [0]
    (tmp_path / "in" / "page-1.html").write_text("b")
    assert go() == [0, 1]


def test_states_and_fixtures(spark):
    assert paged.restore(paged.checkpoint("page:3", "2026")) == {"version": 1, "cursor": "page:3", "highWaterMark": "2026"}
    assert paged.restore("junk") == paged.restore(None) == paged.restore('{"version": 2}') == {}
    assert paged.fixtures(spark, {"u": [{"status": 200}, {"status": 503}]}).count() == 2


def test_registry(tmp_path):
    assert registry.expand({"a": ["${X}/b"]}, {"X": "x"}) == {"a": ["x/b"]}
    (tmp_path / "0001_one.sql").write_text("a\r\n")
    found = registry.scripts(tmp_path)
    assert found[0][2] == hashlib.sha256(b"a\n").hexdigest()
    assert registry.drift([(1, found[0][2]), (2, "x")], found) == ["2: missing"] and registry.drift([(1, "y")], found) == ["1: changed"]
    (tmp_path / "0003_three.sql").write_text("c")
    with pytest.raises(ValueError):
        registry.scripts(tmp_path)


def test_publish_is_idempotent_and_isolated(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, "b")]
    spark.createDataFrame(rows, "event_id long, type string").write.parquet(str(tmp_path / "in"))
    heard = []

    def broken(_):
        raise RuntimeError("no")

    stream = spark.readStream.schema("event_id long, type string").parquet(str(tmp_path / "in"))
    intake.publish(stream, str(tmp_path / "j"), str(tmp_path / "cp"), [broken, lambda b: heard.append(b.count())]).awaitTermination(60)
    assert heard == [3] and spark.read.parquet(str(tmp_path / "j")).dropDuplicates(["event_id"]).count() == 2


def test_stream_deduplication_and_windows(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 10).alias("event_id"), F.timestamp_millis(1_700_000_000_000 + F.col("id") % 10 * 600_000).alias("ts"), F.lit("x").alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("once", intake.deduplicated(stream())), ("windows", intake.windowed_counts(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 10
    assert spark.table("windows").agg(F.sum("events")).first()[0] > 0  # the last windows are still open
