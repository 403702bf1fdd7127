import random

import pytest
from pyspark.sql import functions as F

from cutloom.functions import languages, levels, names, timecode, vectors
from cutloom.functions.fold import without_accents


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


def frames(text, fps):
    h, m, s, f = (int(x) for x in text.replace(";", ":").split(":"))
    n = round(fps)
    out = (h * 3600 + m * 60 + s) * n + f
    if ";" in text and n in (30, 60) and fps < n:
        out -= 2 * (n // 30) * (h * 60 + m - (h * 60 + m) // 10)
    return out


def test_timecodes_against_rule(spark):
    rnd, rows = random.Random(3), []
    for _ in range(300):
        fps = rnd.choice([24.0, 23.976, 25.0, 29.97, 30.0, 59.94])
        sep = rnd.choice(":;")
        rows.append((f"{rnd.randrange(24):02d}:{rnd.randrange(60):02d}:{rnd.randrange(1, 60):02d}{sep}{rnd.randrange(4, 24):02d}", fps))
    df = spark.createDataFrame(rows, "tc string, fps double")
    got = df.select("tc", "fps", timecode.smpte_to_frames(F.col("tc"), F.col("fps")).alias("f"), timecode.frames_to_smpte(timecode.smpte_to_frames(F.col("tc"), F.col("fps")), F.col("fps"), F.col("tc").contains(";")).alias("back")).collect()
    for r in got:
        assert r.f == frames(r.tc, r.fps)
        drops = r.fps in (29.97, 59.94)
        assert r.back == (r.tc if drops else r.tc.replace(";", ":"))


def test_timecode_edges(spark):
    c = F.col("x")
    assert one(spark, timecode.smpte_to_frames(c, 24.0), x="1.5") == 36
    assert one(spark, timecode.smpte_to_frames(c, 24.0), x="1:2:3") is None
    assert one(spark, timecode.smpte_to_frames(c, 24.0), x="ab:cd:ef:gh") is None
    assert one(spark, timecode.smpte_to_frames(c, 0.0), x="00:00:01:00") is None
    assert one(spark, timecode.smpte_to_frames(c, 24.0), x=" ") is None
    assert one(spark, timecode.parse_time_value(c, 24.0), x="12") is None
    assert one(spark, timecode.seconds_value(c, 24.0), x="00:00:02:12") == 2.5
    assert one(spark, timecode.frames_to_smpte(c, 24.0), x=-5) == "00:00:00:00"


def test_names(spark):
    c = F.col("x")
    assert one(spark, names.speaker_key(c), x="Drövav  d'Été 2") == "DROVAVDETE2"
    assert one(spark, names.safe_name(c), x="..a b/c..") == "a_b_c"
    assert one(spark, names.safe_name(c), x="///") == "item"
    assert one(spark, names.source_group_from_text(c), x="Speaker-7 take") == "speaker_07"
    assert one(spark, names.clean_text(c), x="<i>Hello</i>\n(off)  there. Change Note: cut") == "Hello there"
    assert one(spark, names.pad_shot_id(c, 4), x=" 12 ") == "0012"
    assert one(spark, names.pad_shot_id(c), x="A7") == "A7"
    assert one(spark, names.speaker_list(c, upper=True), x="Ann; bob,ann , ") == ["ANN", "BOB"]
    roles = {"music_effects": "ME", "M&E": "ME", "d": "D", "speaker:ann": "D", "speakers": None, "speech": None, "music_cue:1": "M", "score": None, "effects:wind": "E", "foley": None}
    assert {r: one(spark, names.role_group(c), x=r) for r in roles} == roles
    stems = {"vocal": "dialogue", "x_dialogue1": "dialogue", "redux": None, "a_dx": "dialogue", "instrumental": None, "mx-1": "music_fx", "effect": "effects", "sfx": None}
    assert {r: one(spark, names.stem_role(c), x=r) for r in stems} == stems
    heard = {"thank you.": False, "Thank you so much.": False, "please subscribe": True, "come in now": True, "a b!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!": True, "one": False}
    assert {t: one(spark, names.plausible_speech(c, F.lit(1.0)), x=t) for t in heard} == heard
    assert one(spark, names.infer_shot_id(c), x="/a/0042/0042_speaker_01.wav") == "0042"
    assert one(spark, names.word_capacity(c), x="it_is, so") == 3
    assert one(spark, without_accents(c), x="Ñandú straße é") == "Nandu strasse e"


def test_levels_and_languages(spark):
    c = F.col("x")
    assert one(spark, levels.power_db(c), x=0.0) == -120
    assert abs(one(spark, levels.lufs(c), x=1.0) + 0.691) < 1e-9
    assert one(spark, levels.truthy(c), x=" No ") is False
    assert one(spark, levels.truthy(c), x="kept") is True
    assert one(spark, levels.parse_rate(c), x="30000/1001") == 30000 / 1001
    assert one(spark, levels.parse_rate(c), x="1/0") == 0
    assert one(spark, levels.optional_float(c), x=" ") is None
    assert one(spark, languages.language_code(c), x=" German ") == "de"
    assert one(spark, languages.recogniser_code(c), x="Klingon") == "klingon"
    assert one(spark, languages.is_spaceless(c), x="ja") is True
    known = {"farsi": "fa", "Deutsch": "de", "Mandarin": "zh", "mk": "mk", "Swahili": "sw", "kiswahili": "sw", "Filipino": "tl", "tl": "tl", "bn": None, "eng": None, "YUE": "yue", "": None}
    assert {x: one(spark, languages.language_code(c), x=x) for x in known} == known
    assert one(spark, languages.language_name(c), x="persian (farsi)") == "Persian"
    assert len(languages.LANGUAGES) == 31 and languages.supported()[0][0] == "Arabic" and languages.supported()[1][-1] == "zh"
    assert one(spark, languages.validated(c), x="Thai") == "th"
    with pytest.raises(Exception, match="Unsupported language Klingon. Supported speech languages: Arabic, Cantonese"):
        one(spark, languages.validated(c), x="Klingon")


def test_fingerprints(spark):
    import hashlib
    import json

    values = ["b.wav", "ä", "a"]
    entry = {v: json.dumps({"value_type": "str", "sha256": hashlib.sha256(json.dumps(v).encode()).hexdigest()}, sort_keys=True) for v in values}
    df = spark.createDataFrame([(v,) for v in [*values, "", None]], "v string").select("v", levels.value_entry("v").alias("entry"))
    got = df.agg(levels.list_fingerprint(F.collect_list(F.struct(F.col("v").alias("label"), "entry"))).alias("x")).first().x
    whole = hashlib.sha256("".join(v + entry[v] for v in sorted(values)).encode()).hexdigest()
    assert (got["count"], got["sha256"]) == (3, whole)
    assert levels.stable_digest({"b": 1, "a": [2]}) == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()
    content = spark.createDataFrame([(bytes(range(250)),)], "c binary")
    assert content.select(levels.content_fingerprint(F.col("c"), 100)).first()[0] == hashlib.sha256(bytes([*range(100), *range(150, 250)])).hexdigest()
    assert content.select(levels.content_fingerprint(F.col("c"), 200)).first()[0] == hashlib.sha256(bytes(range(200))).hexdigest()


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, vectors.cosine(a, b), x=1) - 0.5**0.5) < 1e-12
    assert one(spark, vectors.cosine(F.array(F.lit(0.0), F.lit(0.0)), b), x=1) == 0
    box = lambda *v: F.array(*[F.lit(x) for x in v])
    assert abs(one(spark, vectors.box_iou(box(0, 0, 2, 2), box(1, 0, 2, 2)), x=1) - 1 / 3) < 1e-12
