"""Captions, chapter lists and edit lists as rows of text, ready for ``write.text``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import format_timecode, frame_at, smpte


def caption_blocks(cues: DataFrame, by: list[str], style: str = "srt") -> DataFrame:
    """A block of text per cue (``start``, ``end``, ``text``), numbered from 1 in each file: ``n``, ``block``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", "text"))
    mark = "," if style == "srt" else "."
    times = F.concat(format_timecode(F.col("start"), mark), F.lit(" --> "), format_timecode(F.col("end"), mark))
    return cues.withColumn("n", n).select(*by, "n", F.concat(F.col("n").cast("string"), F.lit("\n"), times, F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"))


def edit_lines(clips: DataFrame, by: list[str], fps: int = 30) -> DataFrame:
    """Lines of an edit decision list: ``n`` from 1 and ``line`` with source and record times. Clips have ``id``,
    ``source`` (text, cut to 8 letters and digits), ``in_ms``, ``out_ms`` and ``start``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("start", "id"))
    code = lambda ms: smpte(frame_at(ms, fps), fps)
    reel = F.rpad(F.substring(F.upper(F.regexp_replace("source", "[^A-Za-z0-9]", "")), 1, 8), 8, " ")
    end = F.col("start") + F.col("out_ms") - F.col("in_ms")
    line = F.concat_ws(" ", F.lpad(F.col("n").cast("string"), 3, "0"), reel, F.lit("V     C       "), code(F.col("in_ms")), code(F.col("out_ms")), code(F.col("start")), code(end))
    return clips.withColumn("n", n).select(*by, "n", line.alias("line"))


def chapter_lines(chapters: DataFrame, by: str, least_ms: int = 10000, at_least: int = 3) -> DataFrame:
    """Chapter lists (``start``, ``title``): repeated titles fold into the first, of two in one second the later stays,
    the first begins at 0, chapters shorter than ``least_ms`` join the one before, and fewer than ``at_least`` give none."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, str]] = []
        for r in pdf.sort_values(["start", "title"]).itertuples():
            if rows and rows[-1][1] == r.title:
                continue
            if rows and rows[-1][0] // 1000 == r.start // 1000:
                rows.pop()
            rows.append((int(r.start), r.title))
        if rows:
            rows[0] = (0, rows[0][1])
        kept = rows[:1]
        for at, title in rows[1:]:
            if at - kept[-1][0] >= least_ms:
                kept.append((at, title))
        kept = kept if len(kept) >= at_least else []
        return pd.DataFrame([(pdf[by].iloc[0], i + 1, at, t) for i, (at, t) in enumerate(kept)], columns=[by, "n", "start", "title"])

    return chapters.select(by, F.col("start").cast("long").alias("start"), "title").groupBy(by).applyInPandas(fold, f"{by} {dict(chapters.dtypes)[by]}, n int, start long, title string")


def chapter_line(start: Column, title: Column) -> Column:
    """``M:SS title``, with hours where there are any."""
    s = F.floor(start / 1000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s / 60) % 60), two(s % 60))).otherwise(F.concat_ws(":", F.floor(s / 60).cast("string"), two(s % 60)))
    return F.concat_ws(" ", clock, title)
