"""Orders printed as bundles: odd tables and what their plans may not do."""

import pytest
from pyspark.sql import functions as F

from sheafline.operators import checks, fields
from sheafline.plans import adapters, catalog


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """sf0.001 cut to a few orders, of which one (38399 = 19 * 43 * 47, without lines) has no document at all."""
    out = str(tmp_path_factory.mktemp("sparse"))
    orders = adapters.table(spark, "/root/testdata/sf0.001", "orders").filter("o_orderkey < 40")
    alone = orders.limit(1).withColumn("o_orderkey", F.lit(38399).cast(orders.schema["o_orderkey"].dataType))
    orders.unionByName(alone).coalesce(1).write.parquet(f"{out}/orders.parquet")
    for name, kept in (("lineitem", "l_orderkey < 40 and l_orderkey % 7 <> 1"), ("customer", "true")):
        adapters.table(spark, "/root/testdata/sf0.001", name).filter(kept).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


def test_an_order_without_documents_is_a_bundle(spark, sparse):
    found = checks.long_checks(adapters.order_bundles(spark, sparse)).filter("bundle_id = 38399")
    assert [(r.rule_id, r.status) for r in found.orderBy("rule_id").collect()] == [("R0", "fail")] + [(f"R{i}", "unknown") for i in range(1, 9)]
    assert catalog.order_routes(spark, sparse).filter("bundle_id = 38399").first().route == "REQUEST_MORE"


def test_documents_of_a_row_get_the_cells_that_documents_get_alone(spark, sparse):
    alone = checks.bundles(fields.finalize(adapters.order_documents(spark, sparse)))
    within = adapters.order_view(spark, sparse, undocumented=False)
    a, b = ({r.bundle_id: (r.docs, r.present, r.unreadable, r.c_sao_ke) for r in df.collect()} for df in (alone, within))
    assert a == b and 38399 not in a


def test_cells_and_checks_are_made_once_and_not_grouped_again(spark, sparse):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cells = plan(fields.long_fields(fields.finalize(adapters.order_documents(spark, sparse))))
    assert not [x for x in cells.split("\n") if x.lstrip(" :+-").startswith("Filter") and "size(" in x]
    assert plan(adapters.order_view(spark, sparse)).count("Aggregate") == 1  # that of the lines


def test_an_evaluation_broadcasts_no_table_of_bundles(spark):
    from sheafline.plans import bundles
    from sheafline.sources.generator import generate
    from sheafline.sources.stage import stored

    made = stored(generate(spark, 4, "test"), "manifest")
    found = bundles.evaluate(made, stored(bundles.run(made), "decided"))
    for name in ("accuracy", "pairs", "statements", "schema_errors", "auto_pass_data"):
        assert "BroadcastHashJoin" not in found[name]._jdf.queryExecution().executedPlan().toString(), name


def test_a_worker_holds_few_generated_bundles_at_once():
    import pandas as pd

    from sheafline.sources import generator

    sizes = [len(x) for x in generator.lines(iter([pd.DataFrame({"id": range(600)})]), "test", 42)]
    assert sum(sizes) == 600 and max(sizes) <= 256


def test_generated_bundles_are_parsed_once(spark):
    from sheafline.sources.generator import generate
    from sheafline.sources.manifest import documents

    plan = documents(generate(spark, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter") and "size(" in x]


def test_statements_are_scored_by_one_grouping_of_rows(spark):
    from sheafline.operators import metrics

    made = lambda rows: spark.createDataFrame(rows, "bundle_id bigint, ngay date, mo_ta string, so_tien bigint, loai string").withColumn("ngay", F.lit("2024-01-01").cast("date"))
    truth, read = made([(1, None, "x", 5, "ghi_co")] * 2 + [(1, None, "x", None, "ghi_no")]), made([(1, None, "x", 5, "ghi_co"), (1, None, "x", None, "ghi_no")])
    found = metrics.row_scores(truth, read)
    assert tuple(found.first()) == (3, 1 / 3, 0.5, 2, 0.5)  # a row with a null amount equals none
    assert "Join" not in catalog.statement_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_queries_over_orders_make_only_what_they_read(spark, sparse):
    from sheafline.plans import catalog_io

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for made in (catalog.order_messages, catalog.order_flags, catalog_io.name_majorities, catalog_io.order_name_suggestions):
        assert "from_json" not in plan(made(spark, sparse)), made.__name__  # no statement is parsed
    for made in (catalog.order_checks, catalog.order_tallies):
        assert "differs from" not in plan(made(spark, sparse)), made.__name__  # nor a message written


def test_usual_forms_are_read_like_any(spark):
    from sheafline.functions import parse
    from sheafline.functions.text import for_ascii, strip_accents

    days = ["01/02/2024", "ngày 03 tháng 04 năm 1999", "31/02/1990", "00/01/2000", "01/00/2000", "01-01-0000", "2024-01-15", "2024-1-5", "1/2/2024", "01.02.24", "01/02/2024 10:00", "2024", "", " 05-06-2007\n", None]
    found = spark.createDataFrame([(x,) for x in days], "s string").select("s", parse.day(F.col("s")).alias("a"), parse.any_day(F.col("s")).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and sum(r.a is not None for r in found) >= 6
    amounts = {"1,234": 1234, "12": 12, "1,23": 123, "1234": 1234, "999,999,999,999,999,999,999": None, ",1": 1, "1,234\n": 1234, "1,5 trieu": 1500000, "": None, None: None}
    found = spark.createDataFrame([(x,) for x in amounts], "s string").select("s", parse.money(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in found} == amounts
    words = ["Nguyễn Đức", "e\u0301", "각", "Æß", "ώ", "abc", None]
    found = spark.createDataFrame([(x,) for x in words], "s string").select(strip_accents(F.col("s")).alias("a"), for_ascii(F.col("s")).alias("b")).collect()
    assert [r.a for r in found] == ["Nguyen Duc", "e", "\u1100\u1161\u11a8", "Æß", "ω", "abc", None] and [r.b for r in found][:2] == ["Nguyen Duc", "e"]
