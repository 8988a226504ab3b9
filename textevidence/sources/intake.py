"""Intake of files: dispatch by extension, size gates, text and DOCX bytes, media kinds, gold files.

Page pictures, PDF bytes and speech need outside engines; their results enter as tables (pages, attempts).
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS, collapse, strip

#: Size limits in bytes and the known extensions and kinds.
MOST_DOCUMENT, MOST_AUDIO, MOST_IMAGE, MOST_BODY = 10 * 1024 * 1024, 8 * 1024 * 1024, 4 * 1024 * 1024, 65_536
TEXT, DOCX, PDF, IMAGES = [".txt", ".md", ".csv"], ".docx", ".pdf", [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"]
OCR_LANGUAGES = {"": "ben+eng", "en": "eng", "english": "eng", "eng": "eng", "bn": "ben", "ben": "ben", "bengali": "ben"}
IMAGE_KINDS = ["image/jpeg", "image/png", "image/webp"]
AUDIO_KINDS = ["audio/webm", "audio/ogg", "audio/m4a", "audio/mp4", "audio/mpeg", "audio/wav"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension(path: Column) -> Column:
    """The lower-case suffix from the last full stop of a file's name on; empty if there is none."""
    return F.regexp_extract(F.lower(F.regexp_extract(path, r"([^/\\]*)\z", 1)), r"(\.[^.]*)\z", 1)


def intake_kind(ext: Column) -> Column:
    """text, docx, pdf, image, or unsupported."""
    return F.when(ext.isin(*TEXT), "text").when(ext == DOCX, "docx").when(ext == PDF, "pdf").when(ext.isin(*IMAGES), "image").otherwise("unsupported")


def intake_error(ext: Column, size: Column) -> Column:
    """Why a file is refused, or null; its size is looked at before its type."""
    known = ", ".join(sorted([*TEXT, DOCX, PDF, *IMAGES]))
    named = F.when(ext == "", "unknown").otherwise(ext)
    return F.when(size > MOST_DOCUMENT, F.lit("Document exceeds 10 MB.")).when(intake_kind(ext) == "unsupported", F.format_string(f"Unsupported file type '%s'. Supported types: {known}.", named))


def decode_text(content: Column) -> Column:
    """UTF-8, else UTF-16 (little end first) if that is what a replacement character shows, else UTF-8 with losses; without a leading mark."""
    lossy = F.make_valid_utf8(content.cast("string"))
    wide = F.decode(content, "UTF-16LE")
    text = F.when(F.contains(lossy, F.lit("�")) & ~F.contains(wide, F.lit("�")), wide).otherwise(lossy)
    return F.regexp_replace(text, "^﻿", "")


@F.pandas_udf(T.StringType())
def _docx_xml(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return z.read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None

    return content.map(one)


def xml_text(xml: Column) -> Column:
    """Text of a document's XML: tags to spaces, entities opened in this order, white space collapsed."""
    text = F.regexp_replace(F.replace(xml, F.lit("</w:p>"), F.lit("\n")), "<[^>]+>", " ")
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(to))
    return collapse(text)


def docx_text(content: Column) -> Column:
    """Text of DOCX bytes; null if they are no such archive."""
    return xml_text(_docx_xml(content))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_extension, bytes, kind, text, error): the text of text and DOCX files; others have a null text.

    Empty files give no row: the binary reader skips them.
    """
    files = read_files(spark, path).withColumn("file_extension", extension(F.col("path")))
    error = intake_error(F.col("file_extension"), F.col("length"))
    kind = intake_kind(F.col("file_extension"))
    body = F.when(error.isNull(), F.col("content"))
    text = F.when(kind == "text", decode_text(body)).when(kind == "docx", docx_text(F.when(kind == "docx", body)))
    return files.select("path", "file_extension", F.col("length").alias("bytes"), kind.alias("kind"), text.alias("text"), error.alias("error"))


def ocr_language(hint: Column) -> Column:
    """The engine's language for a hint; unknown hints pass."""
    low = F.lower(strip(F.coalesce(hint, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in OCR_LANGUAGES.items() for x in p]), low), low)


def audio_kind(mime: Column) -> Column:
    """A media type without parameters, wave spellings as one."""
    plain = strip(F.lower(F.split(mime, ";")[0]))
    return F.when(plain.isin("audio/wave", "audio/x-wav"), "audio/wav").otherwise(plain)


def scan_kind(content: Column) -> Column:
    """Media type of a page picture by its first bytes; png if they say nothing."""
    return F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", "image/jpeg").otherwise("image/png")


def photo_kind(content: Column) -> Column:
    """Media type of a photo by its first bytes; jpeg if they say nothing."""
    start = F.hex(F.substring(content, 1, 2))
    return F.when(start == "FFD8", "image/jpeg").when(start == "8950", "image/png").when((start == "5249") | (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp").otherwise("image/jpeg")


def decode_audio(encoded: Column) -> Column:
    """struct(content, status): bytes of base64 audio; 400 for no base64, 413 for too many bytes, else 200."""
    content = F.try_to_binary(encoded, F.lit("base64"))
    return F.struct(content.alias("content"), F.when(content.isNull(), 400).when(F.octet_length(content) > MOST_AUDIO, 413).otherwise(200).alias("status"))


def media_status(mime: Column, content: Column, kinds: list[str], most: int) -> Column:
    """415 for a media type that is not taken, 400 for no bytes, 413 for too many, else 200."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(~F.coalesce(audio_kind(mime).isin(*kinds), F.lit(False)), 415).when(size == 0, 400).when(size > most, 413).otherwise(200)


def body_status(body: Column) -> Column:
    """413 for a JSON body of too many bytes, 400 for no JSON, else 200."""
    return F.when(F.octet_length(body) > MOST_BODY, 413).when(F.try_parse_json(body).isNull() & (strip(body) != "null"), 400).otherwise(200)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a gold file: one JSON object with an array of entries."""
    return spark.read.option("multiLine", "true").json(path).select("schema_version", F.explode("entries").alias("entry")).select("schema_version", "entry.*")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"^[{WS}]*\z")

