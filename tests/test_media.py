import json

import pytest
from pyspark.sql import functions as F

from cutloom import schemas
from cutloom.operators import analysis, media, sequences, timeline
from cutloom.sources.captured import captured, schema_of


def test_stereo_program(spark):
    mono = lambda n: [(i, 1, "mono") for i in range(n)]
    cases = {
        "eight": (mono(8), ("first_mono_pair_2_0_program", [0, 1])), "stereo": ([(0, 1, ""), (3, 0, "Stereo")], ("stereo_stream", [3])), "surround": ([(0, 1, None), (1, None, "5.1(side)")], ("downmix_5_1_stream", [1])),
        "six": (mono(6), ("downmix_six_mono_5_1", list(range(6)))), "one": ([(4, 1, "mono")], ("first_audio_stream_to_stereo", [4])),
    }
    df = spark.createDataFrame([(k, *s) for k, (streams, _) in cases.items() for s in streams], "k string, index int, channels int, layout string")
    assert {r.k: (r.choice, r.indices) for r in media.stereo_program(df, ["k"]).collect()} == {k: want for k, (_, want) in cases.items()}


def test_masters_roles_bounds_and_units(spark):
    df = spark.createDataFrame([("/a/M.MOV", False), ("/a/s/f.0001.exr", False), ("/a/s", True)], "p string, d boolean")
    assert [tuple(r.x) for r in df.select(media.master_kind(F.col("p"), F.col("d")).alias("x")).collect()] == [("video", "/a/M.MOV"), ("sequence", "/a/s"), ("sequence", "/a/s")]
    with pytest.raises(Exception, match="unsupported master: /a/b.txt"):
        spark.createDataFrame([("/a/b.txt", False)], "p string, d boolean").select(media.master_kind(F.col("p"), F.col("d"))).collect()
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert [value(media.role_key(F.lit(x))) for x in (" SFX", "room-tone", "voice")] == ["fx", "room_tone", "voice"]
    null = F.lit(None).cast("double")
    assert tuple(value(media.clip_bounds(F.lit(1.0), null, F.lit(2.0), F.lit(3.0)))) == (2, 3) and value(media.clip_bounds(F.lit(1.0), null, F.lit(2.0), null)) is None
    assert [value(media.clip_unit(F.lit(a), F.lit(b), F.lit("c"))) for a, b in ((" l ", "s"), ("", "s"), (" ", ""))] == ["l", "s", "c"]
    names = value(media.shot_media(F.lit("/out"), "my film", F.lit("01/a"), F.lit(True)))
    assert tuple(names) == ("my_film_01_a", "/out/my_film_01_a", "/out/my_film_01_a/my_film_01_a_plate", "/out/my_film_01_a/my_film_01_a_proxy.mov")


def test_faces_representatives_and_labels(spark):
    faces = spark.createDataFrame([("s", "f1", [0, 0, 10, 10]), ("s", "f2", [5, 5, 10, 10]), ("t", "f3", [0, 0, 2, 2]), ("s", "f0", None)], "shot string, face string, box array<int>")
    targets = spark.createDataFrame([("s", [5, 5, 10, 10]), ("t", [50, 50, 2, 2])], "shot string, box array<int>")
    assert [(r.shot, r.face, r.iou) for r in media.best_target_face(faces, targets, ["shot"], "face").collect()] == [("s", "f2", 1.0)]
    clips = spark.createDataFrame([("u", "b", -3.0), ("u", "a", -3.0), ("u", "c", None), ("v", "d", None), (None, "e", 0.0)], "u string, c string, p double")
    assert {(r.u, r.c, r.p) for r in media.representatives(clips, "u", "c", "p").collect()} == {("u", "a", -3.0), ("v", "d", None)}
    windows = spark.createDataFrame([(1, 0, "rain", 0.2), (1, 0, "wind", 0.6), (1, 1, "rain", 0.9), (1, 1, "wind", 0.1)], "k int, window int, label string, score double")
    out = {r.k: (r.label, round(r.confidence, 9)) for r in media.segment_labels(windows, spark.createDataFrame([(1,), (2,)], "k int"), ["k"]).collect()}
    assert out == {1: ("rain", 0.55), 2: ("ambience", 0.0)}
    words = spark.createDataFrame([("x", "phones", 0, "spn"), ("x", "words", 3, "<UNK> "), ("x", "words", 1, "go"), ("x", "words", 5, "<UNK>")], "k string, tier string, i int, label string")
    assert [tuple(r) for r in media.out_of_vocabulary(words, ["k"]).collect()] == [("x", ["<UNK>", "spn"])]


def test_events_and_series(spark):
    bundles = {
        json.dumps({"events": [3, {"start_sec": 1, "end_sec": 2}, {"time": -1, "duration": 4}, {"end": 3}, {"start": 5, "end": 4}, "x", {"start": "a"}]}): [(0.0, 3.0), (1.0, 2.0), (3.0, 3.0)],
        json.dumps({"review_regions": {"regions": [{"start": 2.5}]}}): [(2.5, 2.5)], json.dumps({"beats": "none"}): [], json.dumps({}): [],
    }
    df = spark.createDataFrame([(b,) for b in bundles], "b string")
    got = {r.b: [tuple(e) for e in r.e] for r in df.select("b", analysis.extract_events(F.col("b")).alias("e")).collect()}
    assert got == bundles
    series = {'{"a": [1, 2.5, null]}': [1, 2.5], '{"b": {"scores": [[1, 2], [3]]}}': [1, 2, 3], '{"a": ["x"]}': None, '{"c": [1]}': None, '{"a": []}': None}
    df = spark.createDataFrame([(b,) for b in series], "b string")
    assert {r.b: r.s for r in df.select("b", analysis.numeric_series(F.col("b"), "a", "b").alias("s")).collect()} == series
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert tuple(value(analysis.event_row(F.lit('{"type": "Cue", "time_sec": 2, "end": 1}')))) == ("cue", 2.0, 2.0, "cue") and value(analysis.event_row(F.lit('{"start": "x"}'))) is None
    array = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert value(analysis.normalized_series(array(2, 4, 3))) == [0, 1, 0.5] and value(analysis.normalized_series(array(2, 2))) == [0.5, 0.5]
    assert value(analysis.dominance_shares(array(1, -2, 3))) == [0.25, 0, 0.75]


def brute_pieces(pieces, least):
    out, now = [], None
    for a, b in pieces:
        if now is None:
            now = (a, b)
        elif now[1] - now[0] < least:
            now = (now[0], b)
        else:
            out.append(now)
            now = (a, b)
    if now and now[1] - now[0] < least and out:
        now = (out.pop()[0], now[1])
    return out + ([now] if now else [])


def test_pieces_markers_and_shifts(spark):
    import random

    rnd, rows, want = random.Random(3), [], set()
    for k in range(20):
        cuts = sorted(rnd.sample(range(100), rnd.randrange(2, 12)))
        pieces = [(float(a), float(b)) for a, b in zip(cuts, cuts[1:])]
        rows += [(k, a, b) for a, b in pieces]
        want |= {(k, a, b) for a, b in brute_pieces(pieces, 12)}
    df = spark.createDataFrame(rows, "k int, start double, end double")
    assert {tuple(r) for r in sequences.merge_short_pieces(df, ["k"], 12.0).collect()} == want
    scenes = spark.createDataFrame([("r", 7, -1.0, 0.01, None)], "k string, scene_id int, scene_start double, scene_end double, shot_ids array<string>")
    assert [tuple(r) for r in timeline.scene_markers(scenes, ["k"], 24.0).collect()] == [("r", "SC7", 0, 24, "PURPLE", "7", [])]
    assert [r.start_frame for r in timeline.shifted(spark.createDataFrame([(5,), (50,)], "start_frame bigint"), 10).collect()] == [0, 40]
    assert spark.range(1).select(timeline.first_float(F.lit("x"), F.lit(" 2 "), F.lit("3")).alias("x")).first().x == 2.0


def test_captured_tables(spark, tmp_path):
    spark.createDataFrame([("a", 3, 0.5, "x", 9)], "path string, frame int, score double, detector string, more int").write.parquet(str(tmp_path / "cuts"))
    out = captured(spark, str(tmp_path / "cuts"), "cut_frames")
    assert out.schema == schema_of("cut_frames") and out.first().frame == 3
    (tmp_path / "c.csv").write_text("detector,path,frame,score\nx,a,oops,1.5\n")
    assert tuple(captured(spark, str(tmp_path / "c.csv"), "cut_frames", "csv").first()) == ("a", None, 1.5, "x")
    with pytest.raises(ValueError, match="lacks box, confidence"):
        captured(spark, str(tmp_path / "cuts"), "face_detections")
    with pytest.raises(ValueError, match="no captured table nothing"):
        schema_of("nothing")
    assert len(schemas.TABLES) > 15
