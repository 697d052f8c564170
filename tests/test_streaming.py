import datetime

from caselight.streaming import events as S


def test_windows_and_state(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(minutes=10 * i), i % 2, float(i)) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/in")
    stream = S.read_events(spark, f"{tmp_path}/in", "event_id long, ts timestamp_ntz, user_id long, value double")
    out = S.tumbling(stream, "ts", "user_id", "value").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.sql("SELECT sum(n) n, sum(total) t FROM tumbled").first().asDict() == {"n": 12, "t": 66.0}
    S.to_table(S.once(stream, "ts", "event_id"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12
    q = S.running_totals(stream, "user_id", "value").writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.n, r.total) for r in spark.table("totals").collect()) == [(0, 6, 30.0), (1, 6, 36.0)]
