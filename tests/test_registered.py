"""Every registered query against its SQL in DuckDB, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from quillgauge.catalog import inputs
from quillgauge.operators import batching, budget, code, gate, messages

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    df = entry_points.queries()[name](spark, sf)
    names = sorted(df.columns)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert types == {c: TYPES[t] for c, t in df.dtypes}
    order = [list(types).index(c) for c in names]
    expected = normal(tuple(r[i] for i in order) for r in cursor.fetchall())
    assert normal(tuple(r[c] for c in names) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_plan_queries_give_rows(spark, sf, name):
    assert entry_points.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


# --- plan shapes ------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, sf):
    return spark.sql(inputs.files_sql(inputs.SPARK).replace("FROM documents", f"FROM parquet.`{sf}/documents.parquet`"))


def test_measuring_files_needs_no_shuffle(files):
    for df in (code.raw_metrics(files), code.halstead(files), code.maintainability(files), code.blocks(files),
               code.lines(files), code.targets(files), gate.over_limit(gate.scores(files))):
        assert "Exchange" not in plan(df)


def test_blocks_are_scanned_once(files):
    for df in (code.blocks(files), gate.violations(files), code.targets(files)):
        # The start state of the scan, once for every time it runs.
        assert plan(df).count("[0,0,null,0,[],[],[],0,0,0,0,0]") == 1


def test_exclusions_are_a_broadcast_anti_join_only_when_small(spark, files):
    small = spark.createDataFrame([("cyclomatic", "a", "f")], "metric STRING, part STRING, block STRING")
    text = plan(gate.violations(files, small))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "NestedLoop" not in text
    wide = spark.range(300_000).selectExpr("'cyclomatic' AS metric", "string(id) AS part", "string(id) AS block")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(gate.violations(files, wide))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_caps_are_cut_before_the_shuffle(spark, sf):
    changes = inputs.changes(spark, sf)
    for df in (budget.cap_per_group(changes, ["repo"], ["path"], 30), budget.pack_excerpts(budget.compact(changes), ["repo"]),
               budget.untracked_snippets(budget.compact(changes), ["repo"])):
        assert "WindowGroupLimit" in plan(df)


def test_no_cross_joins_or_single_partitions(spark, sf):
    found = {name: plan(query(spark, sf)) for name, query in entry_points.queries().items() if name in (
        "q_gate", "q_block_lines", "q_batches", "q_bundle", "q_excerpts", "q_dedupe", "q_attempt_order", "q_stop_on_error")}
    for name, text in found.items():
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "SinglePartition" not in text, name


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(batching.is_large(batching.weighted(inputs.changes(spark, sf))))
    assert "text" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert "Window" not in plan(messages.dedupe_keep_first(inputs.attempts(spark, sf), ["item_id"], "attempt_no", "raw"))
    assert "TakeOrderedAndProject" in plan(entry_points.queries()["q_top_worst"](spark, sf))
