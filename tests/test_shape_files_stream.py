import csv
import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wrenlight.operators import shape
from wrenlight.plans import collect as plans
from wrenlight.schemas import LABELLED, RAW_TWEET, TWEET, TWEETS, USERS
from wrenlight.sources import checked, files, keyed_table
from wrenlight.sources.keyed_table import KeyedTable
from wrenlight.sources.scratch import scratch_path, stored_observed
from wrenlight.streaming import intake


def user(number, name="n"):
    return {"id": number, "name": name, "screen_name": f"s{number}", "statuses_count": 1}


def tweet(number, by=1, text="t", count=0, **more):
    return {
        "id": number, "full_text": text, "created_at": "Wed Oct 10 20:19:24 +0000 2018",
        "retweeted": False, "retweet_count": count, "favorited": False, "favorite_count": 0,
        "user": user(by), "unknown": 1, **more,
    }


def land(folder, name, tweets):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(t) + "\n" for t in tweets))
    time.sleep(0.05)


def tables(spark):
    place = scratch_path(spark, "tables")
    return (
        KeyedTable(spark, f"{place}/tweets", TWEETS, "tweet_id", 10, "id"),
        KeyedTable(spark, f"{place}/users", USERS, "twitter_user_id", 10, "id"),
    )


def test_nested_rows(spark, tmp_path):
    land(tmp_path / "in", "tweets1.json", [tweet(1, extended_tweet={"full_text": "long"}), {"id": 2}])
    raw = files.read_json_lines(spark, f"{tmp_path}/in/tweets")
    rows = {r["tweet_id"]: r for r in shape.tweet_rows(raw).collect()}
    assert rows[1]["tweet_text"] == "long" and rows[1]["user_id"] == 1
    assert rows[1]["created_at"].isoformat() == "2018-10-10T20:19:24"
    assert rows[2]["tweet_text"] is None and rows[2]["created_at"] is None
    assert shape.tweet_rows(raw).schema == TWEET
    assert [r["twitter_user_id"] for r in shape.user_rows(raw).collect()] == [1]


def test_class_filters(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (2), (4), (NULL) AS t(polarity)")
    assert shape.of_class(df, 4).count() == 1
    assert [r[0] for r in shape.non_neutral(df).collect()] == [0, 4, None]


def test_csv(spark, tmp_path):
    text = '0,7,"Mon","NO_QUERY",bob,"say ""hi"" caf\xe9, ok"\n4,8,d,q,ann,null\n'
    (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
    rows = files.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r["text"] for r in rows] == ['say "hi" café, ok', "null"]
    files.export_csv(spark.createDataFrame(rows), ["tweet_id", "text"], f"{tmp_path}/out")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out")
    assert back.columns == ["tweet_id", "text"] and back.count() == 2


def test_json_appends(spark, tmp_path):
    for number in (1, 2):
        files.append_json_lines(spark.range(number), f"{tmp_path}/out")
    assert files.read_json_lines(spark, f"{tmp_path}/out/part", spark.range(1).schema).count() == 3


def test_keyed_table(spark):
    table, _ = tables(spark)
    schema = "tweet_id long, tweet_text string, retweet_count int, seq int"
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "a", 1, 0), (25, "b", 1, 0)], schema), ["retweet_count"], ["seq"])
    table.upsert(spark.createDataFrame([(1, "z", 9, 0), (2, "c", 1, 0)], schema), ["retweet_count"], ["seq"])
    table.insert_ignore(spark.createDataFrame([(1, "y", 5, 0), (3, "d", 5, 0)], schema), ["seq"])
    table.upsert(spark.createDataFrame([], schema), ["retweet_count"], ["seq"])
    rows = table.read().collect()
    found = {r["tweet_id"]: (r["tweet_text"], r["retweet_count"]) for r in rows}
    assert found == {1: ("a", 9), 2: ("c", 1), 3: ("d", 5), 25: ("b", 1)}
    assert len({r["id"] for r in rows}) == len(rows) == 4


def test_keyed_table_rewrites_touched_folders_only(spark):
    table, _ = tables(spark)
    schema = "tweet_id long, tweet_text string, retweet_count int, seq int"

    def files_of(slice_):
        return sorted(f for f in table.read().inputFiles() if f"slice={slice_}/" in f)

    rows = [(n, "a", 1, 0) for n in (0, 10, 25)]
    table.upsert(spark.createDataFrame(rows, schema), ["retweet_count"], ["seq"])
    before = {n: files_of(n) for n in (0, 1, 2)}
    assert all(before.values())
    table.upsert(spark.createDataFrame([(11, "b", 2, 0)], schema), ["retweet_count"], ["seq"])
    assert files_of(0) == before[0] and files_of(2) == before[2] and files_of(1) != before[1]
    assert sorted(r["tweet_id"] for r in table.read().collect()) == [0, 10, 11, 25]
    table.insert_ignore(spark.createDataFrame([(10, "c", 3, 0), (12, "c", 3, 0)], schema), ["seq"])
    assert content(table, "tweet_id", "tweet_text") == [(0, "a"), (10, "a"), (11, "b"), (12, "c"), (25, "a")]


def test_folders_do_not_grow_with_a_batch(spark, monkeypatch):
    """A batch over many ranges takes few folders; its keys are found by batches of any size."""
    table, _ = tables(spark)
    schema = "tweet_id long, tweet_text string, retweet_count int, seq int"

    def wide(text, first, count, step):
        rows = spark.range(count).selectExpr(f"id * {step} + {first} tweet_id", f"'{text}' tweet_text")
        return rows.selectExpr("*", "1 retweet_count", "0 seq")

    def folders():
        return {f.rsplit("/", 2)[1] for f in table.read().inputFiles()}

    table.upsert(spark.createDataFrame([(5, "a", 1, 0), (-25, "a", 1, 0)], schema), ["retweet_count"], ["seq"])
    table.upsert(wide("b", -3_000, 1_000, 10), ["retweet_count"], ["seq"])
    assert len(folders()) < 300
    before = folders()
    small = [(-3_000, "c", 7, 0), (-25, "c", 7, 0), (5, "c", 7, 0), (6_990, "c", 7, 0), (None, "c", 7, 0)]
    table.upsert(spark.createDataFrame(small, schema), ["retweet_count"], ["seq"])
    assert len(folders()) == len(before) + 1
    table.insert_ignore(wide("d", -3_000, 2_000, 5), ["seq"])
    monkeypatch.setattr(keyed_table, "LISTED", 3)
    table.upsert(wide("e", -3_000, 6_000, 70), ["retweet_count"], ["seq"])
    rows = table.read().collect()
    expected = {n: ("e", 1) for n in range(-3_000, 417_000, 70)}
    expected |= {n: ("d", 1) for n in range(-3_000, 7_000, 5)}
    expected |= {n: ("b", 1) for n in range(-3_000, 7_000, 10)}
    expected |= {-25: ("a", 7), 5: ("a", 7), 6_990: ("b", 7), None: ("c", 7)}
    assert {r["tweet_id"]: (r["tweet_text"], r["retweet_count"]) for r in rows} == expected
    assert len(rows) == len(expected) == len({r["id"] for r in rows})


def test_repeated_batch_changes_nothing(spark):
    table, _ = tables(spark)
    schema = "tweet_id long, tweet_text string, retweet_count int, seq int"
    batch = spark.createDataFrame([(None, "keyless", 1, 0), (1, "a", 1, 0), (-7, "n", 1, 0)], schema)
    for _ in range(2):
        table.upsert(batch, ["retweet_count"], ["seq"], "first")
    assert table.read().count() == 3
    for _ in range(2):
        table.insert_ignore(batch, ["seq"], "second")
    rows = table.read().collect()
    assert len(rows) == 4 and len({r["id"] for r in rows}) == 4


def test_batch_that_died_half_way_is_mended(spark, monkeypatch):
    """Its staged rows were written for some folders only; repeating it gives all."""
    table, _ = tables(spark)
    schema = "tweet_id long, tweet_text string, retweet_count int, seq int"
    first = spark.createDataFrame([(n, "a", 1, 0) for n in range(0, 60, 5)], schema)
    table.upsert(first, ["retweet_count"], ["seq"], "one")
    whole = KeyedTable._write
    second = spark.createDataFrame([(n, "b", 2, 0) for n in range(0, 80, 4)] + [(None, "k", 2, 0)], schema)

    def half(self, rows, mode):
        whole(self, rows.where("slice % 2 = 0"), mode)
        raise OSError("lost")

    monkeypatch.setattr(KeyedTable, "_write", half)
    with pytest.raises(OSError):
        table.upsert(second, ["retweet_count"], ["seq"], "two")
    monkeypatch.setattr(KeyedTable, "_write", whole)
    table.upsert(second, ["retweet_count"], ["seq"], "two")
    rows = table.read().collect()
    found = {r["tweet_id"]: (r["tweet_text"], r["retweet_count"]) for r in rows}
    expected = {n: ("a", 1) for n in range(0, 60, 5)}
    expected |= {n: ("a", 2) if n % 5 == 0 and n < 60 else ("b", 2) for n in range(0, 80, 4)}
    assert found == expected | {None: ("k", 2)}
    assert len(rows) == len(found) == len({r["id"] for r in rows})


def test_later_row_of_a_file_wins(spark, tmp_path):
    for name, counts in (("up", (5, 7)), ("down", (7, 5))):
        tweets, users = tables(spark)
        land(tmp_path / name, "a.json", [tweet(1, count=c) for c in (1, *counts)])
        run(spark, tmp_path / name, tmp_path / f"p-{name}", tweets, users)
        assert content(tweets, "tweet_id", "retweet_count") == [(1, counts[-1])]
        tweets, _ = tables(spark)
        plans.collect(files.read_json_lines(spark, f"{tmp_path}/{name}/", arrival=True), tweets)
        assert content(tweets, "tweet_id", "retweet_count") == [(1, counts[-1])]


def test_csv_loses_nothing(spark, tmp_path):
    texts = ["  outer  ", "a\nb", "a\r\nb", 'say "hi", ok', "€ ł 漢", "tab\t", None]
    rows = [(4, i, "-", "q", "u", text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, LABELLED)
    files.write_labelled_csv(df, f"{tmp_path}/in", encoding="UTF-8")
    back = files.read_labelled_csv(spark, f"{tmp_path}/in", encoding="UTF-8").collect()
    assert {r["tweet_id"]: r["text"] for r in back} == dict(enumerate(texts))
    files.export_csv(df, ["tweet_id", "text"], f"{tmp_path}/out")
    back = files.read_export(spark, f"{tmp_path}/out", df.select("tweet_id", "text").schema).collect()
    assert {r["tweet_id"]: r["text"] for r in back} == dict(enumerate(texts))
    empty = spark.createDataFrame([(4, 1, "-", "q", "u", "")], LABELLED)
    files.write_labelled_csv(empty, f"{tmp_path}/empty")
    assert files.read_labelled_csv(spark, f"{tmp_path}/empty").first()["text"] in (None, "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [64, 300, 5000, 1 << 20])
def test_csv_of_one_file_in_many_tasks(spark, tmp_path, block, end):
    """Records that start, end and go on anywhere in a block, as a plain reader finds them."""
    draw = random.Random(block)
    pieces = ["plain", "é\n", '"', "\n\n", ",", "x" * 90, '""', "\r", " ", "a,b\n"]
    rows = [[str(4), str(i), "-", "q", "u", "t" + "".join(draw.choices(pieces, k=draw.randrange(6)))] for i in range(150)]
    rows = [[*r[:5], r[5].replace("\r\n", "\n").rstrip("\r")] for r in rows]
    text = io.StringIO()
    csv.writer(text, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)
    (tmp_path / "in.csv").write_bytes(text.getvalue().encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        path = f"{tmp_path}/in.csv"
        if block == 300:
            assert spark.read.text(path).rdd.getNumPartitions() > 10
        back = files.read_labelled_csv(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["tweet_id"]: r["text"] for r in back} == {int(r[1]): r[5] for r in rows}
    assert len(back) == len(rows)


def test_csv_headers_of_each_file(spark, tmp_path):
    for name, rows in (("a", ["1,one", '2,"two\nlines"']), ("b", ["3,three"]), ("c", [])):
        (tmp_path / f"{name}.csv").write_text("\n".join(['n,"long\ntitle"', *rows]) + "\n")
    back = files.read_export(spark, str(tmp_path), StructType.fromDDL("n int, t string")).collect()
    assert sorted(map(tuple, back)) == [(1, "one"), (2, "two\nlines"), (3, "three")]


def test_migrate_and_collect(spark):
    table, users = tables(spark)
    schema = "tweet_id long, tweet_text string, created_at timestamp"
    staging = spark.sql("SELECT 5L tweet_id, 'kept' tweet_text, TIMESTAMP '2018-01-01' created_at")
    plans.migrate(staging, table)
    plans.migrate(spark.createDataFrame([(5, "lost", None)], schema), table)
    raw = spark.createDataFrame([json.dumps(tweet(n)) for n in (4, 5, 6)], "string")
    raw = raw.select(F.from_json("value", RAW_TWEET).alias("t")).select("t.*")
    raw = raw.withColumn("arrived_at", F.lit(1)).withColumn("arrived_in", F.lit("x"))
    plans.collect(raw, table, users)
    found = {r["tweet_id"]: r["tweet_text"] for r in table.read().collect()}
    assert found == {5: "kept", 6: "t"}
    assert users.read().count() == 1


def run(spark, folder, progress, tweets, users, **options):
    intake.start_intake(spark, str(folder), str(progress), tweets, users, **options).awaitTermination()


def content(table, *columns):
    return sorted(tuple(r) for r in table.read().select(*columns).collect())


def test_intake(spark, tmp_path):
    folder, progress = tmp_path / "land", tmp_path / "progress"
    tweets, users = tables(spark)
    refers = tweet(3, by=2, retweeted_status=tweet(1, by=9, text="shadow"))
    lone = tweet(4, by=2, retweeted_status=tweet(40, by=8, text="found"))
    land(folder, "a.json", [tweet(1, by=1, text="one"), refers, lone])
    run(spark, folder, progress, tweets, users)
    assert content(tweets, "tweet_id", "tweet_text") == [(1, "one"), (3, "t"), (4, "t"), (40, "found")]
    assert [r[0] for r in content(users, "twitter_user_id")] == [1, 2, 8, 9]

    before = content(tweets, "id", "tweet_id", "retweet_count")
    run(spark, folder, progress, tweets, users)
    assert content(tweets, "id", "tweet_id", "retweet_count") == before

    land(folder, "b.json", [tweet(1, text="changed", count=5), tweet(1, text="changed", count=7)])
    land(folder, "c.json", [tweet(1, text="again", count=9)])
    run(spark, folder, progress, tweets, users)
    assert (1, "one", 9) in content(tweets, "tweet_id", "tweet_text", "retweet_count")
    assert [row[:2] for row in content(tweets, "id", "tweet_id")] == [row[:2] for row in before]


def test_several_files_equal_one_batch(spark, tmp_path):
    parts = [[tweet(i, by=i % 3, count=i) for i in range(n, n + 6)] for n in (0, 4)]
    results = []
    for name, cap in (("one", None), ("many", 1)):
        folder = tmp_path / f"land-{name}"
        for i, rows in enumerate(parts):
            land(folder, f"{i}.json", rows)
        tweets, users = tables(spark)
        run(spark, folder, tmp_path / f"p-{name}", tweets, users, max_files=cap, refresh_users=False)
        results.append((content(tweets, *TWEET.names), content(users, "twitter_user_id", "name")))
    assert results[0] == results[1]


def test_first_users_stream(spark, tmp_path):
    land(tmp_path / "land", "a.json", [tweet(1, by=1), tweet(2, by=1), tweet(3, by=2)])
    users = intake.first_users(intake.landing_stream(spark, str(tmp_path / "land")))
    query = (
        users.writeStream.format("memory").queryName("first_users").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.awaitTermination()
    assert sorted(r[0] for r in spark.sql("SELECT twitter_user_id FROM first_users").collect()) == [1, 2]


def test_run_is_capped_by_rows_newest_first(spark, tmp_path):
    for i, name in enumerate("abcd"):
        land(tmp_path / "land", f"{name}.json", [tweet(10 * i + k) for k in range(3)])
        time.sleep(0.05)
    tweets, users = tables(spark)
    args = (spark, str(tmp_path / "land"), str(tmp_path / "progress"), tweets, users)
    assert intake.run_intake(*args, max_rows=4)
    assert [r[0] for r in content(tweets, "tweet_id")] == [20, 21, 22, 30, 31, 32]
    assert not intake.run_intake(*args)
    assert len(content(tweets, "tweet_id")) == 12


def test_first_users_over_a_restart(spark, tmp_path):
    _, users = tables(spark)
    for name, who in (("a", (1, 2, 1)), ("b", (2, 3, 1, 3))):
        land(tmp_path / "land", f"{name}.json", [tweet(i, by=u) for i, u in enumerate(who)])
        intake.start_first_users(spark, str(tmp_path / "land"), str(tmp_path / "p"), users).awaitTermination()
    found = content(users, "id", "twitter_user_id")
    assert [u for _, u in found] == [1, 2, 3] or sorted(u for _, u in found) == [1, 2, 3]
    assert len(found) == 3


def test_constraints_are_held_when_writing(spark, tmp_path):
    table, _ = tables(spark)
    parents = spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id long")
    schema = "tweet_id long, tweet_text string, user_id long"
    first = [(1, "b", 1), (1, "a", 1), (2, "c", 9), (None, "d", 2), (None, "e", None), (4, "f", None)]
    second = [(1, "again", 1), (5, "g", 3), (5, "h", 3), (6, "i", 7)]
    for rows in (first, second):
        checked.insert_checked(
            table, spark.createDataFrame(rows, schema).repartition(2), ["tweet_text"], f"{tmp_path}/r", parents, "user_id"
        )
    written = {r["tweet_text"] for r in table.read().collect()}
    assert written == {"a", "d", "e", "f", "g"}
    rejects = {r["tweet_text"]: r["reason"] for r in spark.read.parquet(f"{tmp_path}/r").collect()}
    assert rejects == {
        "b": checked.REPEATED, "c": checked.ORPHAN, "again": checked.KNOWN,
        "h": checked.REPEATED, "i": checked.ORPHAN,
    }


def test_rows_are_counted_by_their_write(spark):
    rows = spark.range(1000).withColumn("part", F.col("id") % 3)
    table, seen = stored_observed(rows, "seen", first=F.count_if(F.col("part") == 0))
    assert seen == {"rows": 1000, "first": 334} and table.count() == 1000


@pytest.mark.parametrize("name", ["stored_ids", "capped_intake"])
def test_landings_are_joined_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """A landing is one file, but the task that writes it doesn't make its rows."""
    from wrenlight.plans import table_queries

    rows = ["id event_id", "timestamp'2024-01-01' ts", "id % 7 user_id", "'view' event_type", "1.0D value", "'{}' props"]
    spark.range(50).selectExpr(*rows).write.parquet(str(tmp_path / "events.parquet"))
    landed = []

    class Landed(Exception):
        pass

    def look(df, folder):
        landed.append(df)
        raise Landed

    monkeypatch.setattr(table_queries.files, "append_json_lines", look)
    with pytest.raises(Landed):
        table_queries.QUERIES[name](spark, str(tmp_path))
    plan = landed[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 1, true" in plan and "Repartition 1, false" not in plan
    assert landed[0].rdd.getNumPartitions() == 1 and landed[0].count() == 50


def test_landings_join_plain_columns(spark, tmp_path):
    """Tweets are made behind the join, so it doesn't shuffle the fields they repeat."""
    from wrenlight.plans import table_queries

    kinds = "element_at(array('view', 'purchase'), int(id % 2) + 1) event_type"
    rows = ["id event_id", "timestamp'2024-01-01' ts", "id % 7 user_id", kinds, "1.0D value", "'{\"k\": 3}' props"]
    spark.range(6).selectExpr(*rows).write.parquet(str(tmp_path / "events.parquet"))
    nested = table_queries._nested_events(spark, str(tmp_path))
    below = nested._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "date_format" not in below and "get_json_object" not in below
    found = {r["id"]: r["retweeted_status"] and r["retweeted_status"]["id"] for r in nested.collect()}
    assert found == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4}
