import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cutloom.kernels import pcm
from cutloom.kernels.columns import audio_blocks, kernel, level_series, wav_headers
from cutloom.sources import cutlists, manifests, transcripts


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_shot_manifests(spark, tmp_path):
    rows = [{"id": "1", "path": "a.mov", "speaker": "Ann", "start": 0.5, "end": "2", "x": 1, "y": 2, "w": 3, "h": 4}, {"shot_id": "2", "file_path": "b.mov"}]
    for content in (rows, {"shots": rows}):
        out = manifests.shots(spark, write(tmp_path / "s.json", json.dumps(content))).orderBy("pos").collect()
        assert [(r.shot_id, r.video_path, r.existing_speaker, r.start_sec, r.end_sec, r.target_face_box) for r in out] == [("1", "a.mov", "Ann", 0.5, 2.0, [1, 2, 3, 4]), ("2", "b.mov", None, None, None, None)]
    csv = write(tmp_path / "s.csv", 'shot_id,video_path,face_box\n7,"c, d.mov","[1, 2, 3, 4]"\n')
    r = manifests.shots(spark, csv).first()
    assert (r.shot_id, r.video_path, r.target_face_box) == ("7", "c, d.mov", [1, 2, 3, 4])
    with pytest.raises(Exception, match="without id"):
        manifests.shots(spark, write(tmp_path / "bad.csv", "shot_id,video_path\n,x\n")).collect()


def test_clip_manifest_keeps_only_kept(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'clip_id,path,kept,embedding\na,/x/9/9_speaker_2.wav,true,"[0.5, 1]"\nb,/x/y.wav,no,\n')
    out = manifests.voice_clips(spark, path).collect()
    assert [(r.clip_id, r.embedding, r.shot_id, r.source_group) for r in out] == [("a", [0.5, 1.0], "9", "speaker_02")]


def test_transcript_csv(spark, tmp_path):
    path = write(tmp_path / "t.csv", "Timecode,Character,English Dialogue\n00:00:01:00,ann,Hello (off) there.\n00:00:02:00,,nobody\n00:00:03:00,Main Title,x\n00:00:09:12,Bob,<i>Bye</i>\n,Bob,no start\n")
    out = transcripts.parse_transcript(spark, path).orderBy("start").collect()
    assert [(r.line_id, r.start, r.end, r.speaker, r.text) for r in out] == [("DL_000001", 1.0, 4.0, "ANN", "Hello there"), ("DL_000004", 9.5, 12.5, "BOB", "Bye")]


def test_xlsx_and_docx(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = "".join(f"<row>{''.join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in row)}</row>" for row in (["Title", ""], ["Start", "Speaker", "Text"], ["1", "Ann", "Hi"], ["", "", ""]))
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>')
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = "".join(f"<w:tr>{''.join(map(cell, row))}</w:tr>" for row in (["Start", "Speaker", "Text"], ["1", "Ann", "Hi"]))
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{table}</w:tbl></w:body></w:document>')
    for name in ("t.xlsx", "t.docx"):
        out = transcripts.transcript_lines(transcripts.raw_rows(spark, str(tmp_path / name)), 24.0).collect()
        assert [(r.start, r.speaker, r.text) for r in out] == [(1.0, "ANN", "Hi")]


def test_textgrid(spark):
    text = 'class = "IntervalTier"\nname = "words"\nintervals [1]:\nxmin = 0\nxmax = 0.5\ntext = "hi"\nintervals [2]:\nxmin = 0.5\nxmax = 1\ntext = ""\nclass = "IntervalTier"\nname = "phones"\nxmin = 0 \nxmax = 0.2 \ntext = "h"'
    out = transcripts.parse_textgrid(spark.createDataFrame([(1, text)], "k int, value string"), "k").collect()
    assert sorted((r.tier, r.start, r.end, r.label) for r in out) == [("phones", 0.0, 0.2, "h"), ("words", 0.0, 0.5, "hi")]


def test_cut_lists(spark, tmp_path):
    txt = write(tmp_path / "c.txt", "# cuts\n1.0\n00:00:02:00\n\n9.0\n")
    got = cutlists.shot_ranges(cutlists.read_cuts(spark, txt), 24.0, total=72).collect()
    assert [(r.shot_id, r.start_frame, r.end_frame) for r in got] == [("001", 0, 24), ("002", 24, 48), ("003", 48, 72)]
    with pytest.raises(ValueError, match="different kinds"):
        cutlists.read_cuts(spark, write(tmp_path / "m.txt", "1 2\n3\n"))
    edl = write(tmp_path / "c.edl", "TITLE: X\n001  R1 V C        00:00:00:00 00:00:01:00 01:00:00:00 01:00:01:00\n* FROM CLIP NAME: one\n002  R1 A C        00:00:01:00 00:00:02:00 01:00:01:00 01:00:02:00\n003  R2 V D 024    00:00:05:00 00:00:06:00 01:00:01:00 01:00:02:00\n")
    got = cutlists.shot_ranges(cutlists.read_cuts(spark, edl), 24.0, origin_frame=86400).collect()
    assert [(r.shot_id, r.start_frame, r.end_frame, r.label) for r in got] == [("001", 0, 24, "one"), ("002", 24, 48, "")]
    csv = write(tmp_path / "c.csv", "Shot ID,Start Frame,End Frame\n2,10,20\n1,0,10\n")
    assert [(r.shot_id, r.start_frame) for r in cutlists.shot_ranges(cutlists.read_cuts(spark, csv), 24.0).collect()] == [("001", 0), ("002", 10)]


def test_image_sequence(spark, tmp_path):
    for n in (1, 2, 4):
        (tmp_path / f"seq.{n:04d}.png").write_bytes(b"x")
    r = manifests.image_sequence(spark, str(tmp_path)).first()
    assert (r.prefix, r.padding, r["first"], r["last"], r.missing) == ("seq.", 4, 1, 4, [3])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", ["x", "y"]), (0, "a", [])], "pos int, id string, names array<string>")
    manifests.write_csv(df, str(tmp_path / "o"), ("id", "names", "more"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "o"), header=True).na.fill("").collect()) == [("a", "", ""), ("b", "x, y", "")]
    manifests.write_manifest(df, str(tmp_path / "m"), "shots", ["pos"], source="edl")
    out = spark.read.json(str(tmp_path / "m")).first()
    assert out.version == "1.0" and out.source == "edl" and [r.id for r in out.shots] == ["a", "b"]


def test_audio_columns(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.wav").write_bytes(pcm.write_wav(np.ones(1000) * 0.5, 1000))
    (tmp_path / "b.wav").write_bytes(b"no wav")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    head = {r.path.rsplit("/")[-1]: (r.rate, r.frames, r.seconds) for r in wav_headers(files).collect()}
    assert head == {"a.wav": (1000, 1000, 1.0), "b.wav": (None, None, None)}
    good = files.where(F.col("path").endswith("a.wav"))
    assert [len(r.samples) for r in audio_blocks(good, 400).orderBy("block").collect()] == [400, 400, 200]
    assert level_series(good).count() == 50
    louder = audio_blocks(good).select(kernel(lambda x: x * 2)("samples").alias("y")).first()
    assert abs(louder.y[0] - 1.0) < 1e-6
