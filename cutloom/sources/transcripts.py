"""Transcripts: CSV, TSV, JSON, XLSX and DOCX, and TextGrid alignments; as Python data sources where Spark has no reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cutloom.functions.names import canonical_speaker_name, clean_text, normalize_header
from cutloom.functions.timecode import seconds_value
from cutloom.sources.manifests import read_rows

#: Normalised headers of each column, and what is no dialogue.
ID = ("line_id", "id", "cue_id", "number", "no")
START = ("start_sec", "start", "in", "in_sec", "time_sec", "time", "start_tc", "start_timecode", "start_time_code", "in_timecode", "in_time_code", "tc", "timecode")
END = ("end_sec", "end", "out", "out_sec", "end_tc", "end_timecode", "end_time_code", "out_timecode", "out_time_code")
SPEAKER = ("speaker", "speaker_name", "character", "character_name", "source", "name", "on_screen_speaker", "onscreen_speaker")
TEXT = ("dialogue", "dialog", "line", "text", "english", "english_dialogue")
STRUCTURAL = ("NARRATIVE TITLE", "MAIN TITLE", "LAST FRAME OF PICTURE")
ON_SCREEN = ("ON-SCREEN TEXT", "ON-SCEEN TEXT")
NO_DIALOGUE = r"(?i)^<(walla|laughing walla|sings|sing|indistinct)[^>]*>\s*(\(|$)"


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, row by row."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(row.iter(f"{ns}c")):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1 if letters else n
                value = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def docx_rows(content: bytes) -> list[list[str]]:
    """Cells of a document's table with most rows."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    tables = [[["\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in c.iter(f"{ns}p")) for c in r.findall(f"{ns}tc")] for r in t.findall(f"{ns}tr")] for t in root.iter(f"{ns}tbl")]
    return max(tables, key=len, default=[])


def header_row(rows: list[list[str]], first: int = 10) -> int:
    """The first of ten rows that names both a speaker and a text column; 0 for none."""
    norm = lambda v: re.sub("[^a-z0-9]+", "_", str(v or "").strip().lower()).strip("_")
    for i, row in enumerate(rows[:first]):
        names = {norm(c) for c in row}
        if names & set(SPEAKER) and names & set(TEXT):
            return i
    return 0


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            content = f.read()
        rows = xlsx_rows(content) if partition.value.lower().endswith(".xlsx") else docx_rows(content)
        top = header_row(rows)
        head = [str(h) for h in rows[top]] if rows else []
        for i, row in enumerate(rows[top + 1 :]):
            if any(str(c).strip() for c in row):
                yield i, {h: str(c) for h, c in zip(head, row) if h}


class TableFile(DataSource):
    """Rows of an XLSX or DOCX file: pos and cells by header. spark.read.format('table_file').load(path)."""

    @classmethod
    def name(cls) -> str:
        return "table_file"

    def schema(self) -> str:
        return "pos bigint, cells map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file:"))


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """pos and cells (map by header) of any transcript file."""
    if path.lower().endswith((".xlsx", ".docx")):
        spark.dataSource.register(TableFile)
        return spark.read.format("table_file").load(path)
    df = read_rows(spark, path, "lines")
    return df.select("pos", F.create_map(*[x for c in df.columns if c != "pos" for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("cells"))


def transcript_lines(rows: DataFrame, fps: float, on_screen: bool = False) -> DataFrame:
    """Lines of raw rows: line_id, pos, start, end, speaker, text.

    Columns go by their normalised headers. Rows without speaker, text or start, structural rows, on-screen texts and
    remarks are dropped. A missing id is made from the row's number among all rows, the dropped ones included.
    """
    from pyspark.sql import Window

    cells = F.transform_keys("cells", lambda k, _: normalize_header(k))
    rows = rows.withColumn("__c", cells).withColumn("__n", F.row_number().over(Window.orderBy("pos")))  # a transcript is one file

    def pick(names: tuple[str, ...]) -> Column:
        cells = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.nullif(F.trim(F.try_element_at("__c", n)), F.lit("")))
        return F.get(F.array_compact(cells), F.lit(0))

    start, end = seconds_value(pick(START), fps), seconds_value(pick(END), fps)
    out = rows.select(
        F.coalesce(pick(ID), F.format_string("DL_%06d", "__n")).alias("line_id"), "pos", start.alias("start"), F.coalesce(end, start).alias("end"), canonical_speaker_name(pick(SPEAKER)).alias("speaker"), clean_text(pick(TEXT)).alias("text")
    )
    out = out.where((F.col("speaker") != "") & (F.col("text") != "") & F.col("start").isNotNull() & ~F.col("speaker").isin(*STRUCTURAL) & ~F.col("text").rlike(NO_DIALOGUE))
    if not on_screen:
        for prefix in ON_SCREEN:
            out = out.where(~F.startswith("speaker", F.lit(prefix)))
    return out


def parse_transcript(spark: SparkSession, path: str, fps: float = 24.0, default: float = 3.0, least: float = 0.3, handle: float = 0.18) -> DataFrame:
    """Lines with inferred windows and padded cuts, three places."""
    from cutloom.operators.sequences import infer_windows

    rows = infer_windows(transcript_lines(raw_rows(spark, path), fps).withColumn("one", F.lit(1)), ["one"], default, least).drop("one")
    rows = rows.withColumn("cut_start", F.greatest(F.lit(0.0), F.col("start") - handle)).withColumn("cut_end", F.col("end") + handle)
    return rows.withColumns({c: F.round(c, 3) for c in ("start", "end", "cut_start", "cut_end")})


def parse_textgrid(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """Intervals of TextGrid texts: key, tier, i, start, end, label; empty labels are left out."""
    tiers = F.slice(F.split(text, r'class\s*=\s*"IntervalTier"'), 2, 10_000)
    rows = texts.select(key, F.explode(tiers).alias("__t"))
    rows = rows.withColumn("tier", F.regexp_extract("__t", r'name\s*=\s*"((?:[^"]|"")*)"', 1))
    pattern = r'xmin\s*=\s*([\d.]+)\s*xmax\s*=\s*([\d.]+)\s*text\s*=\s*"((?:[^"]|"")*)"'
    found = F.arrays_zip(*[F.regexp_extract_all("__t", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "start"), (2, "end"), (3, "label"))])
    rows = rows.select(key, "tier", F.posexplode(found).alias("i", "x"))
    out = rows.select(key, "tier", "i", F.col("x.start").cast("double").alias("start"), F.col("x.end").cast("double").alias("end"), F.replace(F.trim(F.col("x.label")), F.lit('""'), F.lit('"')).alias("label"))
    return out.where("label != ''")
