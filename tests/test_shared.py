from pyspark.sql import functions as F

from cadenza.operators.tables import artist_relations
from cadenza.plans import registry
from cadenza.sources import shared, views


def test_partitions_grow_with_the_tables_and_come_back(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(10).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "few.parquet"))
    before = {name: spark.conf.get(name) for name in (shared.PARTITIONS, shared.ADVISORY)}
    try:
        assert shared.file_bytes(spark, str(tmp_path / "many.parquet")) > 500_000
        shared.deal_by_size(spark, str(tmp_path / "few.parquet"), 10_000)
        assert {name: spark.conf.get(name) for name in before} == before
        shared.deal_by_size(spark, str(tmp_path / "many.parquet"), 10_000)
        assert int(spark.conf.get(shared.PARTITIONS)) > 50 and shared._plain_bytes(spark.conf.get(shared.ADVISORY)) == 10_000
    finally:
        shared.deal_as_before(spark)
    assert {name: spark.conf.get(name) for name in before} == before
    assert [shared._plain_bytes(t) for t in ("64MB", "8m", "17b", "5")] == [64 << 20, 8 << 20, 17, 5]


def test_a_large_query_is_dealt_by_its_tables(spark, monkeypatch):
    monkeypatch.setattr(views, "deal_by_size", lambda s, path: shared.deal_by_size(s, path, 1000))
    try:
        registry.queries()["last_n_positives"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(shared.PARTITIONS)) > 50
        monkeypatch.undo()
        registry.queries()["last_n_positives"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(shared.PARTITIONS) == "4"
    finally:
        shared.deal_as_before(spark)


def test_artists_of_a_file_are_united_before_they_are_expanded(spark):
    """No row for each file and artist is shuffled; an artist without a name, and a file that comes twice, count once."""
    files = spark.createDataFrame([(1, "a", "t"), (1, "b", "u"), (2, "a", "none"), (3, "none", "none")], "media_id long, filename string, title string")
    tracks = spark.createDataFrame([("a", "t", "X"), ("a", "x", None), ("b", "t", "X"), ("c", "u", "Y")], "path string, track_key string, artist string")
    found = artist_relations(files, tracks)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([(m, a, r) for m, a in ((1, "X"), (1, None), (1, "Y"), (2, "X"), (2, None)) for r in ("artist", "albumartist")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [media_id" in plan and plan.index("Generate") < plan.index("Aggregate [media_id")


def test_a_task_gets_four_megabytes_of_a_table_at_most(spark, monkeypatch):
    monkeypatch.setattr(shared, "file_bytes", lambda s, path: 425 << 20)
    try:
        shared.deal_by_size(spark, "lineitem")
        assert int(spark.conf.get(shared.PARTITIONS)) >= 106 and shared._plain_bytes(spark.conf.get(shared.ADVISORY)) <= 4 << 20
    finally:
        shared.deal_as_before(spark)
