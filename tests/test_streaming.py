import datetime as dt

from cutloom.streaming import sessions

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, schema, make):
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_word_groups(spark, tmp_path):
    schema = "source string, speaker string, ts timestamp, seconds double, text string"
    rows = [("a", "X", at(0), 0.5, "one"), ("a", "", at(0.6), 0.4, "two"), ("a", "Y", at(1.2), 0.3, "three"), ("a", "Y", at(9), 0.3, "four"), ("b", None, at(500), 0.1, "end")]
    got = run(spark, tmp_path, [rows], schema, lambda s: sessions.word_groups(s, 1.0, "10 seconds"))
    assert {(r.source, r.speaker, r.n_words, r.text) for r in got} >= {("a", "X", 2, "one two"), ("a", "Y", 1, "three")}


def test_gap_sessions(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(3)), ("a", at(20)), ("a", at(300))]
    got = run(spark, tmp_path, [rows[:3], rows[3:]], "k string, ts timestamp", lambda s: sessions.gap_sessions(s, "5 seconds", "10 seconds", ["k"]))
    assert {(r.start, r.n) for r in got} >= {(at(0), 2), (at(20), 1)}
