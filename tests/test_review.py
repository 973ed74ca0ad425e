"""Review state, sources, sinks, the HTTP extractor and the stream."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from sheafline.operators import metrics, review
from sheafline.sources import extract, manifest, sinks
from sheafline.sources.generator import generate
from sheafline.streaming import arrivals


def test_state(spark):
    opened = spark.createDataFrame([("a", "REVIEW", ["R1"], 1.0), ("a", "REVIEW", ["R1"], 5.0), ("b", "REVIEW", [], 2.0)], "bundle_id string, route string, reasons array<string>, t double")
    closed = spark.createDataFrame([("a", "x", "valid", "{}", "", 9.0), ("zz", "x", "valid", "{}", "", 9.0)], "bundle_id string, reviewer string, conclusion string, edits string, note string, t double")
    events = review.open_events(opened, F.col("t")).unionByName(review.close_events(closed, F.col("t")))
    got = {r["bundle_id"]: (r["status"], r["opened_at"], r["closed_at"]) for r in review.state(events).collect()}
    assert got == {"a": ("closed", 1.0, 9.0), "b": ("open", 2.0, None)}
    with pytest.raises(Exception, match="not a conclusion"):
        review.close_events(closed.withColumn("conclusion", F.lit("maybe")), F.col("t")).collect()


def test_suggestions(spark):
    ev = lambda d, f, v, k=True: (d, f, v, k, None)
    rows = [
        ("two", [("R2", "fail", "", [ev("don_vay", "so_cccd", "1"), ev("cccd", "so_cccd", "2")])]),
        ("many", [("R1", "fail", "", [ev("don_vay", "ho_ten", "B"), ev("cccd", "ho_ten", "A"), ev("hdld", "ho_ten_nld", "A"), ev("sao_ke", "chu_tk", "A")])]),
        ("unsure", [("R5", "unknown", "", [ev("cccd", "ngay_het_han", None, False), ev("don_vay", "ngay_ky", "2026-01-01")])]),
    ]
    df = spark.createDataFrame(rows, "bundle_id string, checks array<struct<rule_id:string,status:string,message:string,evidence:array<struct<doc_type:string,field:string,value:string,known:boolean,missing:boolean>>>>")
    got = {(r["bundle_id"], r["doc_type"]): [s["value"] for s in (r["why"][0]["suggest"] or [])] for r in review.flagged_fields(df).collect()}
    assert got[("two", "don_vay")] == ["2"] and set(got[("many", "don_vay")]) == {"A"} and got[("many", "cccd")] == []
    assert ("unsure", "cccd") in got and ("unsure", "don_vay") not in got


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


JPEG = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, bytes(65)) + segment(0xDA, bytes(10)) + b"coded\xff\x00data\xff\xd0" * 8 + segment(0xFE, bytes(28)) + segment(0xDA, bytes(10)) + b"more" + b"\xff\xd9"
PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(bytes(900))[:6]) + chunk(b"IDAT", zlib.compress(bytes(900))[6:]) + chunk(b"IEND", b"")


def test_whole_images(spark):
    """Files broken anywhere are told from whole ones."""
    whole = [JPEG, PNG]
    broken = [JPEG[:-2], JPEG[:60] + JPEG[61:], JPEG[:2] + b"\xff\xd9", PNG[:-1], PNG[:40] + b"?" + PNG[41:], PNG[:-24] + chunk(b"IEND", b""), b"", b"GIF89a", JPEG[:9] + b"\xff\xd9", None]
    broken.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"no zlib") + chunk(b"IEND", b""))
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(whole + broken)], "i int, content binary")
    assert [r["ok"] for r in rows.select("i", manifest.image_ok(F.col("content")).alias("ok")).orderBy("i").collect()] == [True] * 2 + [False] * len(broken)


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(JPEG)
    (tmp_path / "b.jpg").write_bytes(JPEG[:-30] + JPEG[-2:])
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.jpg"))
    url = f"file:{tmp_path}"
    docs = spark.createDataFrame([("x", 0, [f"{url}/a.jpg"]), ("x", 1, [f"{url}/a.jpg", f"{url}/b.jpg"]), ("x", 2, [])], "bundle_id string, doc_ord int, files array<string>")
    assert {r["doc_ord"]: r["readable"] for r in manifest.with_readable(docs, files).collect()} == {0: True, 1: False, 2: False}
    m = generate(spark, 4)
    sinks.write_frozen(m, str(tmp_path / "m"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_frozen(m, str(tmp_path / "m"))
    again = manifest.read_manifest(spark, str(tmp_path / "m"))
    assert again.count() == 4 and manifest.documents(again, "root").filter(F.get("files", 0).startswith("root/")).count() == manifest.documents(again).count()
    run = spark.createDataFrame([("r1", 1)], "run_id string, n int")
    sinks.append_run(run, str(tmp_path / "runs"))
    sinks.append_run(run, str(tmp_path / "runs"))
    sinks.append_run(run.withColumn("more", F.lit(1)), str(tmp_path / "runs"))
    sinks.append_run(run.withColumn("other", F.lit(1)), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs_legacy_1")).columns == ["run_id", "n", "more"]
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1 and spark.read.parquet(str(tmp_path / "runs_legacy")).count() == 2
    sinks.append_new(run, str(tmp_path / "keyed"), "run_id")
    sinks.append_new(run, str(tmp_path / "keyed"), "run_id")
    assert spark.read.parquet(str(tmp_path / "keyed")).count() == 1
    replies = spark.createDataFrame([("k", "{}", []), ("l", None, ["late"]), ("m", "{}", ["once"])], "key string, reply string, errors array<string>")
    for _ in range(2):
        sinks.append_replies(replies, str(tmp_path / "cache"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "cache")).collect()] == [("k", "{}")]
    sinks.write_text(spark, str(tmp_path / "note.txt"), "một")
    sinks.write_text(spark, str(tmp_path / "note.txt"), "hai")
    assert (tmp_path / "note.txt").read_text() == "hai" and not (tmp_path / "note.txt.part").exists()
    (tmp_path / "config.json").write_text('{"rules": {"income_tolerance": 0.2}, "thresholds": {"request_more_min_format_errors": 2}}')
    rules, limits = manifest.read_config(str(tmp_path / "config.json"))
    assert rules.income_tolerance == 0.2 and limits.request_more_min_format_errors == 2 and manifest.read_config(str(tmp_path / "config.json"))[0] is rules
    (tmp_path / ".env").write_text("# note\nSOME_KEY_OF_TESTS='x y'\n\nbad line\n")
    assert manifest.read_env(str(tmp_path / ".env")) == {"SOME_KEY_OF_TESTS": "x y"} and manifest.read_env(str(tmp_path / "none")) == {}
    assert manifest.revision(str(tmp_path)) == "unknown"
    left = generate(spark, 4, skip=m.limit(2).select("bundle_id"))
    assert left.count() == 2
    sinks.write_traces(spark.createDataFrame([("x", 1)], "bundle_id string, i int").select("bundle_id", *(F.lit("v").alias(c) for c in ("unreadable", "cells", "checks", "route", "reasons", "rules_version", "thresholds_version"))), str(tmp_path / "traces"), "r1")
    found = manifest.read_traces(spark, str(tmp_path / "traces" / "run_id=r1"), "bundle_id string, route string").collect()
    assert [(r["bundle_id"], r["route"]) for r in found] == [("x", "v")] and found[0]["trace_id"].startswith("part-")
    sinks.export_samples(m, m.select("bundle_id"), m.limit(1), str(tmp_path / "samples"))
    assert spark.read.json(str(tmp_path / "samples" / "manifest")).count() == 1
    bad = manifest.real_data_paths(spark.createDataFrame([("data/real/a.JPG",), ("data/synthetic/a.jpg",), ("x.py",)], "path string"))
    assert [r["path"] for r in bad.collect()] == ["data/real/a.JPG"]


def test_parse_output():
    got = extract.parse_output('```json\n{"ho_ten": {"raw": "A", "page": 1}, "so_cccd": 12, "extra": 1}\n```', "cccd")
    assert got["ho_ten"] == ("A", 1) and got["so_cccd"] == ("12", None) and got["ngay_sinh"] == (None, None) and "extra" not in got
    assert json.loads(extract.parse_output('{"giao_dich": [{"raw": {"ngay": "1"}, "page": 1}]}', "sao_ke")["giao_dich"][0]) == [{"ngay": "1"}]
    with pytest.raises(ValueError):
        extract.parse_output("sorry", "cccd")
    with pytest.raises(ValueError):
        extract.extractor("none")
    assert extract.merge_pages([{"a": (None, 1), "giao_dich": ("[1]", 1)}, {"a": ("x", 1), "giao_dich": ("[2]", 1)}]) == {"giao_dich": ("[1, 2]", 1), "a": ("x", 2)}


def _post(payload):
    if payload["image"] == b"bad":
        raise OSError("timeout")
    return {"choices": [{"message": {"content": '{"ho_ten": "A"}'}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5}}


def test_http_extractor(spark):
    x = extract.HttpExtractor("m", _post, 1.0, 1.0)
    docs = spark.createDataFrame([("b", "d1", "cccd", [bytearray(b"ok")]), ("c", "d1", "cccd", [bytearray(b"bad")])], "bundle_id string, doc_id string, doc_type string, pages array<binary>")
    replies = x.call(x.pages(docs)).cache()
    got = {r["bundle_id"]: r for r in x.extract(docs, replies).collect()}
    assert got["b"]["raw0"]["ho_ten"]["raw"] == "A" and got["b"]["n_calls"] == 2 and abs(got["b"]["cost_usd"] - 3e-5) < 1e-12
    assert got["c"]["n_calls"] == 4 and len(got["c"]["extract_errors"]) == 4 and not got["c"]["raw0"]
    sent = extract.HttpExtractor("m", lambda p: _post({"image": b"bad" if p["image"][-1] else b"ok"}), encode=lambda image, variant: image + bytes([variant]))
    assert sent.call(sent.pages(docs)).filter("reply is not null").count() == 2
    twins = spark.createDataFrame([(f"t{i}", "d1", "cccd", [bytearray(b"ok")]) for i in range(5)], docs.schema)
    assert x.call(x.pages(twins)).count() == 2 and x.pages(twins).select("key").distinct().count() == 2
    assert x.misses(x.pages(docs), replies.filter("reply is not null")).count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", t) for t in ("cccd", "don_vay", "hdld", "sao_ke")] + [("b", "cccd")], "bundle_id string, doc_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bundle_id string, doc_type string").parquet(str(tmp_path / "in"))
    q = arrivals.assemble(stream).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert q.awaitTermination(120)  # one batch: with a timer there is always another, so processAllAvailable() never returns
    assert [(r["bundle_id"], r["complete"]) for r in spark.sql("select * from arrived").collect()] == [("a", True)]


def test_order_in_large_groups(spark):
    """Neighbours and exact ranks, with a group that has most rows, ties, nulls and few rows."""
    import math
    import random
    import statistics

    dice = random.Random(4)
    rows = [("big" if i % 10 else "small", i * 7 % 5003, f"b{i}", float(dice.randint(0, 300)) if i % 13 else None) for i in range(3000)] + [(None, 5, "n1", 1.0), (None, 9, "n2", 3.0)]
    d = spark.createDataFrame(rows, "class string, pos long, bundle_id string, ms double").repartition(5)
    got = {r["bundle_id"]: (r["prev"], r["next"]) for r in review.neighbours(d, "class", "pos").collect()}
    for c in ("big", "small", None):
        own = [r[2] for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert all(got[b] == (own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None) for i, b in enumerate(own))
    for by in (["class"], None):
        for r in metrics.latency(d, "ms", by).collect():
            own = sorted(x[3] for x in rows if x[3] is not None and (by is None or x[0] == r["class"]))
            assert (r["p50"], r["p95"]) == (statistics.median(own), own[math.ceil(95 * len(own) / 100) - 1])


def test_edits(spark):
    row = spark.createDataFrame([({"a": "1", "b": None, "c": "3"}, {"a": "2", "b": None, "d": "4"})], "x map<string,string>, y map<string,string>")
    assert {k: (v["from"], v["to"]) for k, v in row.select(review.edits(F.col("x"), F.col("y")).alias("e")).first()["e"].items()} == {"a": ("1", "2"), "c": ("3", None), "d": (None, "4")}


def test_queue(spark):
    d = spark.createDataFrame([("a", "REVIEW", "An", "scan"), ("b", "AUTO_PASS", "Bo", "scan"), ("c", "REQUEST_MORE", "Ca", "clean")], "bundle_id string, route string, customer string, augment string")
    items = spark.createDataFrame([], "bundle_id string, status string, opened_at double, closed_at double, reviewer string")
    names = lambda **kw: sorted(r["bundle_id"] for r in review.queue(d, items, **kw).collect())
    assert names() == ["a", "c"] and names(only="AUTO_PASS") == ["b"] and names(search="CA") == ["c"] and names(augment="scan") == ["a"]
