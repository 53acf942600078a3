"""Streams against the same functions on tables: late rows, missing credentials, restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators.masking import mask_frame
from palimpsest.streaming.counts import counted, session_counts, start_counting, windowed_counts
from palimpsest.streaming.restoring import left_out, restore_replies, start_restoring

DAY = datetime(2024, 3, 1, 10)


def minutes(n):
    return DAY + timedelta(minutes=n)


def test_replies_and_credentials(spark, tmp_path):
    texts = [(k, f"write to a{k}@x.yz, otp: 1234{k}") for k in range(1, 8)]
    asked = mask_frame(spark.createDataFrame(texts, "k int, text string"))
    masked_at = {1: 0, 2: 1, 3: 2, 4: 90, 5: 95, 6: 3000, 7: 3001}
    creds = asked.join(spark.createDataFrame([(k, minutes(m)) for k, m in masked_at.items()], "k int, masked_at timestamp"), "k").select("k", "masked_at", "meta")
    masks = {r.k: r.masked for r in asked.collect()}
    reply = lambda i, k, m, text=None: (i, k, minutes(m) if m is not None else None, text or f"re: {masks.get(k, '__PII_EMAIL_ADDRESS_1__')} ok")
    steps = [
        ([1, 2, 3], [reply(1, 1, 5), reply(2, 9, 6), reply(3, 2, 7), reply(4, 4, 91)]),  # 4's credential comes later
        ([4, 5], [reply(5, 1, 20, "twice: __PII_EMAIL_ADDRESS_1__"), reply(6, 5, 94), reply(7, None, 95)]),  # 6 was asked for after its reply
        ([6, 7], [reply(8, 6, 3010)]),  # the watermark passes all above
        ([1], [reply(9, 3, 30), reply(10, 7, 3020), reply(11, 2, 3005)]),  # 9 is too late, 11 beyond its credential's reach
        ([], [reply(12, 6, 9000)]),
        ([7], [reply(13, 7, 9001)]),
    ]
    schema = "i int, k int, replied_at timestamp, reply string"
    every = spark.createDataFrame([r for _, rows in steps for r in rows], schema)
    folder = str(tmp_path)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/replies")
    creds.limit(0).write.parquet(f"{folder}/creds")
    read = lambda what, like: spark.readStream.schema(like.schema).parquet(f"{folder}/{what}")
    late = creds.withColumn("masked_at", F.when(F.col("k") == 7, F.lit(minutes(9000))).otherwise(F.col("masked_at")))
    for n, (keys, rows) in enumerate(steps):
        (late if n == 5 else creds).where(F.col("k").isin(keys)).coalesce(1).write.mode("append").parquet(f"{folder}/creds")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/replies")
        # Started anew each time: state and progress come from the checkpoint alone.
        start_restoring(read("replies", every), read("creds", creds), "k", f"{folder}/out", f"{folder}/checkpoint", reach="1 day", delay="1 hour").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    got = {r.i: (r.restored, r.found) for r in out.collect()}
    want = {r.i: (r.restored, r.found) for r in restore_replies(every, creds, "k", reach="1 day").collect()}
    assert out.count() == len(got) and set(got) >= {1, 2, 3, 4, 5, 6, 7, 8, 10, 11} and 9 not in got
    assert all(got[i] == want[i] for i in got)
    assert {i for i in want if not want[i][1]} == {2, 6, 7, 11, 12, 13} and want[4][0] == "re: write to a4@x.yz, otp: 12344 ok" and want[5][0] == "twice: a1@x.yz"
    rest = restore_replies(left_out(every, out, ["i"]), creds, "k", reach="1 day")
    assert got | {r.i: (r.restored, r.found) for r in rest.collect()} == want and "a3@x.yz" in want[9][0]


def test_credentials_that_come_after_their_replies(spark, tmp_path):
    """A reply waits in the state for a credential that arrives later, if its time is right."""
    asked = mask_frame(spark.createDataFrame([(1, "x a@b.cd"), (2, "y c@d.ef")], "k int, text string")).withColumn("masked_at", F.lit(minutes(0)))
    creds, folder = asked.select("k", "masked_at", "meta"), str(tmp_path)
    replies = asked.select("k", F.lit(minutes(1)).alias("replied_at"), F.col("masked").alias("reply"))
    creds.limit(0).write.parquet(f"{folder}/creds")
    replies.where("k = 1").write.parquet(f"{folder}/replies")
    run = lambda: start_restoring(spark.readStream.schema(replies.schema).parquet(f"{folder}/replies"), spark.readStream.schema(creds.schema).parquet(f"{folder}/creds"), "k", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    run()
    assert spark.read.schema("k int").parquet(f"{folder}/out").count() == 0
    creds.write.mode("append").parquet(f"{folder}/creds")
    replies.where("k = 2").write.mode("append").parquet(f"{folder}/replies")
    run()
    assert {r.restored for r in spark.read.parquet(f"{folder}/out").collect()} == {"x a@b.cd", "y c@d.ef"}


EVENTS = [(i, "a" if i % 3 else "b", minutes(m)) for i, m in enumerate([0, 5, 12, 14, 61, 62, 63, 130, 131, 200, 7, 58, 400])] + [(99, "a", None)]


def test_windows_of_streams_equal_those_of_tables(spark, tmp_path):
    folder, frame = str(tmp_path), spark.createDataFrame(EVENTS, "i int, kind string, ts timestamp")
    parts = [frame.where("i < 4"), frame.where("i BETWEEN 4 AND 9"), frame.where("i BETWEEN 10 AND 11"), frame.where("i >= 12")]  # 10 and 11 are late
    frame.limit(0).write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
    tumbling = lambda df: windowed_counts(df, "ts", ["kind"], "1 hour", delay="4 hours")
    sessions = lambda df: session_counts(df, "ts", ["kind"], "20 minutes", delay="4 hours")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start_counting(stream(), "ts", ["kind"], f"{folder}/sliding", f"{folder}/c0", "1 hour", "30 minutes").awaitTermination()
        for name, counts in (("tumbling", tumbling), ("sessions", sessions)):
            made = counts(stream()).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/c-{name}").outputMode("append")
            made.trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    # The watermark stands 4 hours behind the newest event, at 2:40 after the first: windows that end by then are out, late rows counted.
    closed = F.col("window_end") <= F.lit(minutes(160))
    for name, counts in (("tumbling", tumbling), ("sessions", sessions)):
        assert rows(spark.read.parquet(f"{folder}/{name}")) == rows(counts(frame).where(closed)) != [], name
    whole = windowed_counts(frame, "ts", ["kind"], "1 hour", "30 minutes")
    assert rows(counted(spark.read.parquet(f"{folder}/sliding"), ["kind"])) == rows(whole)
    # A batch that runs again replaces its part.
    again = windowed_counts(parts[0], "ts", ["kind"], "1 hour", "30 minutes")
    again.write.mode("overwrite").parquet(f"{folder}/sliding/batch=1")
    assert counted(spark.read.parquet(f"{folder}/sliding"), ["kind"]).count() > 0


def test_documents_of_the_restoring_query_are_masked_once(spark, tmp_path, monkeypatch):
    from palimpsest.plans import table_queries

    spark.createDataFrame([(1, "mail a@b.cd", "en", "web", 11), (2, "nothing", "en", "web", 7), (3, None, "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    masked, real = [], table_queries.mask_frame
    monkeypatch.setattr(table_queries, "mask_frame", lambda *a, **k: masked.append(1) or real(*a, **k))
    rows = table_queries.restore_stream(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.found) for r in rows) == [(1, True), (2, False)] and len(masked) == 1
