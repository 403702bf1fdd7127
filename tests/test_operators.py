import json

from pyspark.sql import functions as F

from cutloom.operators import activity, identity, registry, statistics, timeline


def test_tone_spans_join_neighbours_of_one_group(spark):
    gaps = spark.createDataFrame([("r", "a", 0.0, 2.0), ("r", "a", 4.0, 6.0), ("r", "b", 8.0, 10.0)], "k string, group string, start double, end double")
    totals = spark.createDataFrame([("r", 20.0)], "k string, total double")
    got = sorted((r.start, r.end, r.group) for r in activity.tone_spans(gaps, totals, ["k"]).collect())
    assert got == [(0.0, 7.0, "a"), (7.0, 20.0, "b")]


def test_gap_reasons_and_probe_starts(spark):
    df = spark.createDataFrame([(-90.0, 0.0, 0.0), (-40.0, 0.9, 0.1), (-40.0, 0.2, 0.1)], "rms_db double, peak double, rms double")
    assert [r.reason for r in activity.accepted_gaps(df).collect()] == ["digital_silence", "transient", None]
    a, b = spark.range(1).select(activity.probe_starts(F.lit(3600.0), 30.0, 3).alias("a"), activity.probe_starts(F.lit(10.0), 30.0, 3).alias("b")).first()
    assert a[:3] == sorted(a[:3]) and a[0] < 1200 < a[1] < 2400 < a[2] and len(set(a)) == 12 and max(a) <= 3570 and b == [0.0]


def test_keyframes_keep_off_the_cuts(spark):
    got = [tuple(spark.range(1).select(activity.keyframes(F.lit(a), F.lit(b), n)).first()[0]) for a, b, n in ((100, 200, 3), (10, 12, 3), (10, 11, 3), (0, 7, 3), (0, 8, 3), (100, 200, 1))]
    assert got == [(102, 150, 197), (10, 11), (10,), (0, 3, 6), (2, 4, 5), (149,)]


def test_tracks_and_document(spark):
    rows = [("r", "A", "c1", 0, 10), ("r", "A", "c2", 5, 10), ("r", "A", "c3", 20, 5), ("r", "B", "c4", 3, 2)]
    placed = spark.createDataFrame(rows, "k string, g string, clip string, start_frame bigint, frames bigint")
    tracks = timeline.tracks(placed, ["k"], "g")
    got = {(r.g, r.lane): [(i.kind, i.clip, i.frames) for i in r["items"]] for r in tracks.collect()}
    assert got == {("A", 0): [("clip", "c1", 10), ("gap", None, 10), ("clip", "c3", 5)], ("A", 1): [("gap", None, 5), ("clip", "c2", 10)], ("B", 0): [("gap", None, 3), ("clip", "c4", 2)]}
    doc = json.loads(timeline.otio_json(tracks, ["k"], "g", 24.0).first().json)
    assert doc["OTIO_SCHEMA"] == "Timeline.1" and [t["name"] for t in doc["tracks"]["children"]] == ["A 1", "A 2", "B 1"]


def test_scene_tags(spark):
    clips = spark.createDataFrame([("r", "s1", 0.0), ("r", "s9", 12.0)], "k string, shot_id string, start_sec double")
    scenes = spark.createDataFrame([("r", "001", 10.0, 20.0, ["x"]), ("r", "002", 20.0, 30.0, ["s1"])], "k string, scene_id string, scene_start double, scene_end double, shot_ids array<string>")
    assert {r.shot_id: r.scene_id for r in timeline.tag_scenes(clips, scenes, ["k"]).collect()} == {"s1": "002", "s9": "001"}


def test_registry(spark):
    known = spark.createDataFrame([(1, "Old", [1.0]), (2, "", [2.0])], "cluster_id bigint, name string, centroid array<double>")
    new = spark.createDataFrame([(1, "", [3.0]), (2, "Ann Lee", [4.0]), (3, "Nobody", [5.0])], "cluster_id bigint, name string, centroid array<double>")
    names = spark.createDataFrame([("ANNLEE", "ann"), ("OLD", "old")], "key string, speaker_key string")
    out = registry.upsert_clusters(known, new, names)
    assert {r.cluster_id: (r.name, r.speaker_key) for r in out.collect()} == {1: ("OLD", "old"), 2: ("ANN LEE", "ann"), 3: ("", None)}
    reg = spark.createDataFrame([("ann", [7]), ("old", None)], "speaker_key string, voice_clusters array<bigint>")
    assert {r.speaker_key: r.voice_clusters for r in registry.link(reg, out, "voice_clusters").collect()} == {"ann": [2, 7], "old": [1]}
    labels = registry.label_template(out.withColumn("evidence_count", F.col("cluster_id")), "voice").collect()
    assert [(r.cluster_ref, r.current_name) for r in labels] == [("voice:3", "")]


def test_single_centroid_has_a_wide_margin(spark):
    clips = spark.createDataFrame([("c", [1.0, 0.0]), ("n", None)], "clip string, embedding array<double>")
    known = spark.createDataFrame([(1, "A", [1.0, 1.0])], "cluster_id int, speaker string, centroid array<double>")
    r = identity.best_two(clips, known, "clip").collect()
    assert len(r) == 1 and r[0].second == -1 and abs(r[0].margin - (0.5**0.5 + 1)) < 1e-9


def test_silence_has_floor_loudness(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.1)], "k string, e double")
    got = {r.k: r.loudness for r in statistics.integrated_loudness(df, ["k"], "e").collect()}
    assert got["a"] == -120 and abs(got["b"] + 10.691) < 1e-9


def test_blocks_of_centroids_give_the_same_best(spark, monkeypatch):
    import random

    rnd = random.Random(1)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    clips = spark.createDataFrame([(f"c{i}", vec()) for i in range(20)], "clip string, embedding array<double>")
    known = spark.createDataFrame([(i, f"S{i % 7}", vec()) for i in range(23)], "cluster_id int, speaker string, centroid array<double>")
    whole = sorted(tuple(r) for r in identity.best_two(clips, known, "clip").collect())
    monkeypatch.setattr(identity, "BROADCAST_ROWS", 5)
    assert sorted(tuple(r) for r in identity.best_two(clips, known, "clip").collect()) == whole


def test_clip_candidates(spark):
    import pytest

    lines = spark.createDataFrame([("l1", "a", 0.0, 1.0), ("l2", "", 0.0, 0.1), ("l3", None, 0.0, 2.0)], "line_id string, source_group string, start double, end double")
    stems = spark.createDataFrame([("s1", "a"), ("s2", "b")], "stem_id string, source_group string")
    heard = spark.createDataFrame([("l1", "s1", -10.0, 0.5), ("l2", "s1", -10.0, 0.5), ("l3", "s2", -70.0, 0.0)], "line_id string, stem_id string, peak_dbfs double, voiced_ratio double")
    got = {(r.line_id, r.stem_id): (r.kept, r.reason) for r in identity.clip_candidates(lines, stems, heard).collect()}
    assert got == {("l1", "s1"): (True, ""), ("l2", "s1"): (False, "too short"), ("l2", "s2"): (False, "too short; silent; not voiced"), ("l3", "s1"): (False, "silent; not voiced"), ("l3", "s2"): (False, "silent; not voiced")}
    with pytest.raises(ValueError):
        identity.clip_candidates(lines.union(spark.createDataFrame([("l4", "z", 0.0, 1.0)], lines.schema)), stems, heard)
