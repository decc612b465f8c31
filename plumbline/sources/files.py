"""Texts inside ZIP and DOCX files, read in parallel with caps on what is unpacked."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAX_MEMBER, MAX_TOTAL = 2_000_000, 50_000_000
TEXT_SUFFIXES = (".sql", ".xml", ".java", ".py", ".md", ".txt", ".csv", ".json", ".yaml", ".yml")


def members(content: bytes, most: int = MAX_TOTAL, largest: int = MAX_MEMBER) -> Iterator[tuple[str, str | None, str | None]]:
    """(name, text, left_out) of a ZIP's text members. One that is too large, or comes after too many bytes, or climbs out of the
    archive, has no text and says why it is left out."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if info.is_dir() or not info.filename.lower().endswith(TEXT_SUFFIXES):
                continue
            why = "climbs out" if ".." in info.filename.split("/") else "too large" if info.file_size > largest else "archive too large" if total + info.file_size > most else None
            if why is None:
                total += info.file_size
            yield info.filename, None if why else z.read(info).decode("utf-8", "replace"), why


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    import html

    return "\n".join(html.unescape("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p))) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, member, text and left_out of every archive's members, document and text file under a path; what is too large has
    no text and says so."""

    def run(frames):
        for frame in frames:
            out = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                low = p.lower()
                if low.endswith(".zip"):
                    out += [(p, *m) for m in members(content)]
                elif low.endswith(".docx"):
                    out.append((p, "", docx_text(content), None))
                elif low.endswith(TEXT_SUFFIXES):
                    large = len(content) > MAX_MEMBER
                    out.append((p, "", None if large else content.decode("utf-8", "replace"), "too large" if large else None))
            yield pd.DataFrame(out, columns=["path", "member", "text", "left_out"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, text string, left_out string")
