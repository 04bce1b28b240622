"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinosift.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, sql, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    result = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_encoder_has_unit_vectors(spark):
    rows = registry.QUERIES["encode_texts"](spark, SF).collect()
    assert rows and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-5 for r in rows)


def test_cosine_reaches_every_frame(spark):
    found = registry.QUERIES["cosine"](spark, SF)
    every = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert found.select("frame_id").distinct().count() == every and found.count() == every * found.select("query_id").distinct().count()


@pytest.mark.parametrize("name", ["chosen_edges", "sequence_best_frame", "position_modes"])
def test_sequences_are_not_filed_under_buckets(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["sequence_best_frame", "position_modes"])
def test_an_event_is_shuffled_a_few_times(spark, tmp_path, name):
    """At two sizes, without the broadcasts that hide a shuffle of small tables."""

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(listed.apply, range(listed.size()))}

    events = spark.read.parquet(f"{SF}/events.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for times in (1, 6):
            copies = events.crossJoin(spark.range(times)).selectExpr("event_id + 1000003 * id AS event_id", "ts", "user_id + 1000003 * id AS user_id")
            copies.write.parquet(f"{tmp_path}/{times}/events.parquet")
            last = max(stages())
            registry.QUERIES[name](spark, f"{tmp_path}/{times}").write.parquet(f"{tmp_path}/{times}/found")
            assert 0 < sum(n for stage, n in stages().items() if stage > last) <= 6 * times * events.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
