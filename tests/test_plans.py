"""Physical plans keep their promises, and registered queries agree with their SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeloom.operators import queue, routing, scan, symbols
from codeloom.plans import analyze
from suite.views import Tables
from tests.corpus import frame
from tools.check import canonical, duck

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def raw_files(tables):
    return tables.documents.select(
        F.col("source").alias("repo"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.col("text").alias("content"))


def test_summary_is_one_stage_over_the_needed_columns(tables):
    text = plan(scan.security_summary(raw_files(tables)))
    assert "Exchange" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>", text)


def test_text_never_reaches_a_shuffle(tables):
    files = raw_files(tables)
    for df in (scan.files_per_identifier(files), scan.call_tokens(files), analyze.liveness(analyze.build_index(files))):
        for line in plan(df).splitlines():
            assert not ("Exchange hash" in line and "content" in line)


def test_no_nested_loops_or_cartesian_products(tables):
    index = analyze.build_index(raw_files(tables))
    for df in (analyze.liveness(index), queue.pending_grouped(tables.queue), queue.block_reason(tables.queue, by_owner=True)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_top_k_is_cut_before_the_shuffle(tables):
    text = plan(routing.recent_decisions(tables.decisions))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_reach_the_scan(tables):
    text = plan(entry.queries()["projects_for"](tables.spark, FOLDER))
    assert "EqualTo(c_nationkey,3)" in text


def test_parser_reads_only_what_it_needs(tables):
    text = plan(symbols.extract_symbols(raw_files(tables)).filter("bucket = 'class'"))
    assert "MapInArrow" in text and "Exchange" not in text


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    oracle = entry.oracle_sql()[name]
    got = canonical(entry.queries()[name](spark, FOLDER).toArrow())
    assert got == canonical(duck(FOLDER).sql(oracle).to_arrow_table())


def test_index_summary_returns_the_used_names_of_every_module(spark, tmp_path):
    """Names with digits, marks and other letters, a null one, and modules that don't parse; the SQL has no form for nulls."""
    names = ["large ring", "a 2nd_x été", "Box if _ i", "naïve-9 x9", "don't pad"] * 50
    parts = spark.createDataFrame([(k, names[k], k % 50) for k in range(250)], "p_partkey long, p_name string, p_size int")

    def summary(rows, folder):
        rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
        texts = [r.content for r in Tables(spark, str(folder)).code.collect()]
        used = {w for content in texts for w in re.findall(r"\b[A-Za-z_]\w+\b", content)}
        got = entry.queries()["index_summary"](spark, str(folder))
        assert got.first().symbols_with_usage == len(used)
        return got

    con = duckdb.connect()
    got = summary(parts, tmp_path / "plain")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/plain/part.parquet/*.parquet'")
    assert canonical(got.toArrow()) == canonical(con.sql(entry.oracle_sql()["index_summary"]).to_arrow_table())
    nulls = parts.withColumn("p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")))
    summary(nulls.unionAll(nulls.limit(20)), tmp_path / "odd")


def test_entry_returns_all_documents(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_kept_index_holds_the_files_as_stored(spark):
    """Scans and edits read stored texts and don't make them anew in each of their branches."""
    made = frame(spark).repartition(3, "path")
    kept = analyze.build_index(made, keep=True).files
    assert kept.inputFiles() and "Repartition" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(kept.collect()) == sorted(made.collect())
