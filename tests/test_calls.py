"""Calls with a limit on those in flight, the page source, and the cache's filter."""

import asyncio
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.sources import calls, extract, page_source

NOW = calls.Policy(in_flight=4, tries=2, delay=0.0, timeout=5.0)


class Service:
    """Replies with the number sent; counts requests in flight; some are slow, some fail once, some always."""

    def __init__(self):
        self.open, self.most, self.lock, self.seen = 0, 0, threading.Lock(), {}

    def post(self, n):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
            self.seen[n] = self.seen.get(n, 0) + 1
        try:
            time.sleep(0.2 if n % 10 == 0 else 0.005)
            if n % 7 == 0 or (n % 5 == 0 and self.seen[n] == 1):
                raise OSError(f"no {n}")
            return {"n": n}
        finally:
            with self.lock:
                self.open -= 1

    async def apost(self, n):
        return await asyncio.to_thread(self.post, n)


@pytest.mark.parametrize("kind", ["post", "apost"])
def test_calls_are_in_order_and_bounded(kind):
    service = Service()
    began = time.perf_counter()
    got = list(calls.in_order(((i, i) for i in range(100)), getattr(service, kind), lambda i, reply: reply["n"], NOW))
    spent = time.perf_counter() - began
    assert [i for i, _ in got] == list(range(100)) and 1 < service.most <= 4
    for i, out in got:
        assert (out.value, out.calls) == ((None, 2) if i % 7 == 0 else (i, 2 if i % 5 == 0 else 1))
        assert out.errors == (["OSError: no %d" % i] * 2 if i % 7 == 0 else [])
    assert spent < 0.75 * sum((0.2 if i % 10 == 0 else 0.005) * n for i, n in service.seen.items())


def test_slow_calls_time_out_and_retries_wait():
    policy = calls.Policy(in_flight=2, tries=3, delay=0.05, timeout=0.05)
    waits = []

    async def post(n):
        waits.append(time.perf_counter())
        await asyncio.sleep(10 if n else 0)
        return n

    (_, bad), (_, good) = calls.in_order([(1, 1), (0, 0)], post, lambda i, r: r, policy)
    assert bad.value is None and bad.calls == 3 and all(e.startswith("TimeoutError") for e in bad.errors) and good.calls == 1
    assert bad.latency_ms >= 3 * 50 + 50 + 100


def test_payloads_are_taken_as_needed():
    taken = []

    def payloads():
        for i in range(1000):
            taken.append(i)
            yield i, i

    found = calls.in_order(payloads(), lambda n: n, lambda i, r: r, NOW)
    assert next(found)[0] == 0 and len(taken) <= 4 * NOW.in_flight
    found.close()


def _post(payload):
    if payload["image"].startswith(b"bad"):
        return {"choices": [{"message": {"content": "cannot read"}}], "usage": {"prompt_tokens": 1}}
    return {"choices": [{"message": {"content": payload["image"].decode()}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5}}


def documents(spark):
    rows = [(f"b{i:03}", "d2", "don_vay", [b'{"ho_ten": "N%d"}' % i, b"bad" if i % 4 == 0 else b'{"ho_ten": "again", "so_dien_thoai": "0%d"}' % i]) for i in range(40)]
    rows += [("b001", "d1", "cccd", [b'{"ho_ten": "N1"}']), ("b000", "d3", "hdld", []), ("b002", "d4", "sao_ke", [b'{"giao_dich": [{"a": 1}]}', b'{"giao_dich": [{"b": 2}]}'])]
    return spark.createDataFrame(rows, "bundle_id string, doc_id string, doc_type string, pages array<binary>")


def test_source_gives_what_calls_give(spark, tmp_path):
    docs = documents(spark)
    x = extract.HttpExtractor("m", _post, 1.0, 1.0, policy=NOW)
    columns = ["key", "reply", "n_calls", "cost_usd", "errors", "bundle_id", "doc_id", "page", "variant"]
    rows = lambda df: sorted(map(repr, map(tuple, df.select(*columns).collect())))
    source = page_source.read_pages(x, docs, str(tmp_path / "pages"), pages_per_partition=10)
    # equal pages (the bad ones) are asked for once a partition there, once in all here
    same = lambda df: df.withColumns({c: F.lit(0) for c in ("bundle_id", "doc_id", "page", "cost_usd")}).dropDuplicates(["key"])
    assert rows(same(source)) == rows(same(x.call(x.pages(docs))))
    made = {r["bundle_id"]: r for r in x.extract(docs, source.dropDuplicates(["key"])).filter("doc_type = 'don_vay'").collect()}
    assert made["b005"]["raw0"]["so_dien_thoai"] == ("05", 2) and made["b005"]["raw1"]["ho_ten"] == ("N5", 1) and "so_dien_thoai" not in made["b004"]["raw0"]


def test_filters_reach_the_source(spark, tmp_path):
    docs, sent = documents(spark), spark.sparkContext.accumulator(0)

    def post(payload):
        sent.add(1)
        return _post(payload)

    x = extract.HttpExtractor("m", post, policy=calls.Policy(in_flight=2, tries=1, delay=0.0))
    source = page_source.read_pages(x, docs, str(tmp_path / "pages"), pages_per_partition=8)
    every = source.rdd.getNumPartitions()
    one = source.filter("bundle_id = 'b007' and variant = 1")
    assert one.rdd.getNumPartitions() < every / 2
    assert sorted((r["bundle_id"], r["page"], r["variant"]) for r in one.collect()) == [("b007", 1, 1), ("b007", 2, 1)] and sent.value == 2
    some = source.filter(F.col("bundle_id").isin("b001", "b030", "none") & (F.col("variant") == 0))
    assert sorted({r["bundle_id"] for r in some.collect()}) == ["b001", "b030"]
    assert source.filter("bundle_id >= 'b037' and variant < 1").count() == 6
    assert source.filter("bundle_id > 'z'").count() == 0 and source.filter("variant = 7").count() == 0
    assert source.filter("size(errors) > 0 and bundle_id = 'b004'").count() == 2


def test_partitions_are_planned_by_pages(spark, tmp_path):
    docs = spark.createDataFrame([("long", "d4", "sao_ke", [b'{"giao_dich": [%d]}' % i for i in range(100)])] + [(f"b{i}", "d1", "cccd", [b"{}"]) for i in range(5)], "bundle_id string, doc_id string, doc_type string, pages array<binary>")
    page_source.write_pages(docs.coalesce(1), str(tmp_path / "pages"), 64)
    reader = page_source.PageReader(extract.HttpExtractor("m", _post), str(tmp_path / "pages"), 16)
    plan = reader.partitions()
    assert max(p.rows for p in plan) <= 16 and sum(p.rows for p in plan) == 2 * 105


def test_shared_cost_is_counted_once(spark):
    docs = spark.createDataFrame([(f"t{i}", "d1", "cccd", [b"{}"]) for i in range(5)], "bundle_id string, doc_id string, doc_type string, pages array<binary>")
    x = extract.HttpExtractor("m", _post, 1.0, 1.0, policy=NOW)
    replies = x.call(x.pages(docs)).cache()
    assert replies.count() == 2
    got = x.extract(docs, replies).agg(F.sum("cost_usd").alias("cost"), F.sum("n_calls").alias("n")).first()
    assert abs(got["cost"] - 3e-5) < 1e-12 and got["n"] == 2
    kept = x.extract(docs, replies.select("key", "reply")).agg(F.sum("cost_usd").alias("cost"), F.sum("n_calls").alias("n"), F.count("raw1").alias("found")).first()
    assert tuple(kept) == (0, 0, 5)


def test_filter_has_no_false_miss(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    for bits in (64, 1 << 12, 1 << 16):
        found = extract.KeyFilter.of(keys, "key", bits)
        assert keys.filter(~found.has(F.col("key"))).count() == 0
    other = spark.range(3000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert other.filter(found.has(F.col("key"))).count() < 60
    assert np.count_nonzero(extract.KeyFilter.of(keys.limit(0), "key", 64).words.value) == 0


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_misses_move_no_images_of_hits(spark, bits, monkeypatch):
    monkeypatch.setattr(extract.KeyFilter.of.__func__, "__defaults__", (bits,))
    docs = documents(spark)
    x = extract.HttpExtractor("m", _post)
    pages = x.pages(docs)
    cache = pages.filter("bundle_id < 'b030'").select("key", F.lit("{}").alias("reply")).distinct()
    got, want = x.misses(pages, cache), pages.join(cache, "key", "left_anti")
    assert got.columns == pages.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*pages.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_plain_calls_time_out_while_others_go_on():
    """A try given up holds its thread, and no more requests are open for it; other errors are raised in their turn."""
    service, release = Service(), threading.Event()

    def post(n):
        if n == 1:
            with service.lock:
                service.seen[n] = service.seen.get(n, 0) + 1
            release.wait(5)
            return {"n": n}
        return service.post(n)

    policy = calls.Policy(in_flight=3, tries=2, delay=0.01, timeout=0.3)
    found = calls.in_order(((i, i) for i in (1, 2, 3, 4, 5, 7)), post, lambda i, reply: reply["n"], policy)
    _, slow = next(found)
    release.set()
    rest = list(found)
    assert slow.value is None and slow.calls == 2 and slow.errors == ["TimeoutError: "] * 2 and slow.latency_ms >= 600 and service.seen[1] == 2 and service.most <= 3
    assert [(i, out.value, out.calls) for i, out in rest] == [(2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 2), (7, None, 2)]

    def broken(n):
        return n / 0 if n == 2 else n

    found = calls.in_order(((i, i) for i in range(5)), broken, lambda i, reply: reply, NOW)
    assert [next(found)[1].value, next(found)[1].value] == [0, 1]
    with pytest.raises(ZeroDivisionError):
        next(found)


def test_plain_calls_need_no_event_loop(monkeypatch):
    """A call by a plain function costs no task of an event loop."""
    monkeypatch.setattr(asyncio, "new_event_loop", None)
    assert [out.value for _, out in calls.in_order(((i, i) for i in range(100)), lambda n: n, lambda i, reply: reply, NOW)] == list(range(100))


def test_calls_are_dealt_to_all_tasks(spark):
    """However few the files of the pages are, calls go to as many tasks as a shuffle has."""
    docs = documents(spark).coalesce(1)
    made = extract.HttpExtractor("m", _post, policy=NOW)
    replies = made.call(made.pages(docs))
    assert replies.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and replies.select("key").distinct().count() == replies.count()


def test_partitions_do_not_grow_with_pages(spark, tmp_path, monkeypatch):
    """Row groups are read together where there would be too many partitions, each page once, and footers stay short."""
    monkeypatch.setattr(page_source, "PARTITIONS", 8)
    monkeypatch.setattr(page_source, "PAGES_PER_PARTITION", 4)
    docs = documents(spark)
    page_source.write_pages(docs.coalesce(1), str(tmp_path / "pages"), 4)
    n = docs.selectExpr("sum(size(pages))").first()[0]
    reader = page_source.PageReader(extract.HttpExtractor("m", _post), str(tmp_path / "pages"))
    plan = reader.partitions()
    files = {p.file for p in plan}
    assert len(plan) <= 8 + 2 * len(files) and sum(p.rows for p in plan) == 2 * n and max(len(p.groups) for p in plan) > 1
    monkeypatch.setattr(reader, "passes", lambda column, value: True)
    read = [(r["bundle_id"], r["doc_id"], r["page"], r["variant"]) for p in plan for r in reader.rows(p)]
    assert len(read) == len(set(read)) and {r[:3] for r in read if r[3] == 1} >= {("b001", "d2", 1), ("b039", "d2", 2), ("b002", "d4", 2)}
    assert page_source.pieces([(0, 5), (1, 3), (3, 2), (4, 9)], 5) == [([0], 0, 5), ([1, 3], 0, 5), ([4], 0, 5), ([4], 5, 4)]
    assert page_source.pieces([(0, 9), (1, 1), (2, 1)], 5) == [([0], 0, 5), ([0], 5, 4), ([1, 2], 0, 2)]
