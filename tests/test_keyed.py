from pyspark.sql import functions as F

from wrenlight.operators import keyed, ranking

SCHEMA = "k long, a string, b string, seq int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_last_and_absent(spark):
    df = frame(spark, [(1, "x", "", 2), (1, "y", "", 1), (None, "n", "", 1), (None, "n", "", 1)])
    assert rows_of(keyed.first_per_key(df, "k", ["seq"])) == rows_of(
        frame(spark, [(1, "y", "", 1), (None, "n", "", 1), (None, "n", "", 1)])
    )
    assert (1, "x", "", 2) in rows_of(keyed.last_per_key(df, "k", ["seq"]))
    known = frame(spark, [(1, "", "", 0), (None, "", "", 0)])
    assert rows_of(keyed.absent(df, known, "k")) == [(None, "n", "", 1)] * 2


def both_ways(target, batch):
    small = keyed.upsert(target, batch, "k", ["a"], ["seq"])
    large = keyed.upsert(target, batch, "k", ["a"], ["seq"], max_rows=0)
    assert rows_of(small) == rows_of(large)
    return small


def test_upsert(spark):
    target = frame(spark, [(1, "old", "keep", 0), (2, "same", "s", 0), (None, "t", "t", 0)])
    batch = frame(
        spark,
        [(1, "new", "lost", 5), (1, "mid", "lost", 4), (3, "ins", "b", 1), (None, "q", "q", 1)],
    )
    once = both_ways(target, batch)
    assert rows_of(once) == sorted(
        [
            (1, "new", "keep", 0),
            (2, "same", "s", 0),
            (3, "ins", "b", 1),
            (None, "t", "t", 0),
            (None, "q", "q", 1),
        ],
        key=str,
    )
    keyed_batch = batch.where("k IS NOT NULL")
    first = keyed.upsert(target, keyed_batch, "k", ["a"], ["seq"])
    assert rows_of(both_ways(first, keyed_batch)) == rows_of(first)


def test_upsert_edges(spark):
    target = frame(spark, [(1, "old", "keep", 0)])
    nothing = frame(spark, [])
    assert rows_of(both_ways(target, nothing)) == rows_of(target)
    assert rows_of(both_ways(nothing, target)) == rows_of(target)
    assert rows_of(both_ways(target, frame(spark, [(1, None, "x", 1)]))) == [(1, None, "keep", 0)]


def test_insert_ignore(spark):
    target = frame(spark, [(1, "old", "", 0)])
    batch = frame(spark, [(1, "no", "", 1), (2, "first", "", 1), (2, "second", "", 2)])
    added = keyed.insert_ignore(target, batch, "k", ["seq"])
    assert rows_of(added) == [(2, "first", "", 1)]


def test_checks(spark):
    child = frame(spark, [(1, "", "", 0), (1, "", "", 1), (2, "", "", 0), (None, "", "", 0)])
    parent = frame(spark, [(2, "", "", 0)])
    assert rows_of(keyed.duplicate_keys(child, "k")) == [(1, 2)]
    assert rows_of(keyed.orphan_keys(child, "k", parent, "k")) == [(1, 2)]
    assert keyed.orphan_rows(child, "k", parent, "k").count() == 2


def test_latest_and_newer(spark):
    df = spark.sql("SELECT * FROM VALUES (5, 3), (9, 1), (7, NULL) AS t(id, at)")
    mark = keyed.latest_id(df, "id", "at")
    assert mark.first()[0] == 5
    assert sorted(r[0] for r in keyed.newer_than(df, "id", mark).collect()) == [7, 9]
    empty = keyed.latest_id(df.where("id < 0"), "id", "at")
    assert empty.first()[0] is None
    assert keyed.newer_than(df, "id", empty).count() == 3
    assert keyed.newer_than(df, "id", 7).count() == 1
    assert keyed.newer_than(df, "id", None).count() == 3


def test_rank_over_many_partitions(spark):
    df = spark.range(5_000).select(
        (F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 10 == 0).cast("int").alias("g")
    )
    ranked = ranking.with_rank(df.repartition(6), ["g"], ["k"]).toPandas().sort_values("k")
    for _, rows in ranked.groupby("g"):
        assert list(rows["rank"]) == list(range(len(rows)))


def test_assigned_ids_continue(spark):
    existing = spark.createDataFrame([(1, 10), (7, 11)], "id long, k long")
    fresh = spark.createDataFrame([(21,), (20,)], "k long")
    assert rows_of(ranking.assign_ids(existing, fresh, ["k"])) == [(8, 20), (9, 21)]


def test_split_sizes(spark):
    sizes = {0: 1, 2: 4, 4: 5, 6: 10, 8: 0}
    rows = [(label, label * 100 + i) for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows + [(9, 999)], "label int, k long")
    parts = ranking.positional_split(df, "label", list(sizes), "k").toPandas()
    assert len(parts) == sum(sizes.values()) and parts["k"].is_unique
    for label, n in sizes.items():
        mine = parts[parts["label"] == label].sort_values("k")
        first, second = int(0.6 * n), int(0.8 * n)
        expected = ["train"] * first + ["val"] * (second - first) + ["test"] * (n - second)
        assert list(mine["part"]) == expected
