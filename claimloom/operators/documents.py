"""Document pages: is the extracted text readable, what becomes evidence, which pages need reading again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

MAX_REPLACEMENT_SHARE = 0.02
MIN_WORD_SHARE = 0.2
MIN_IMAGE_PX = 64
CLEAN_CONFIDENCE = 0.9


def garbled_flag(
    text: Column, fonts_missing: Column, max_replacement_share: float = MAX_REPLACEMENT_SHARE,
    min_word_share: float = MIN_WORD_SHARE,
) -> Column:
    """True when page text cannot be trusted.

    Unmapped-glyph marks or many replacement characters are enough alone; missing font maps count only when hardly
    any letter or digit came out.
    """
    raw = F.coalesce(text, F.lit(""))
    stripped = t.strip(raw)
    replaced = F.length(raw) - F.length(F.replace(raw, F.lit("�"), F.lit("")))
    words = F.length(F.regexp_replace(stripped, r"[^\p{L}\p{N}]", ""))
    share = lambda part, whole: part / F.greatest(F.length(whole), F.lit(1))
    unreadable = (stripped == "") | (share(words, stripped) < min_word_share)
    return (
        raw.rlike(r"\(cid:[0-9]+\)")
        | (share(replaced, raw) > max_replacement_share)
        | (F.coalesce(fonts_missing, F.lit(False)) & unreadable)
    )


def usable_images(doc_images: DataFrame, min_px: int = MIN_IMAGE_PX) -> DataFrame:
    """Images once per page, none below ``min_px`` on a side, numbered from 0 in their order on the page.

    ``doc_images`` has (file, page, ord, xref, ext, width, height).
    """
    once = doc_images.groupBy("file", "page", "xref").agg(F.min_by(F.struct("ord", "ext", "width", "height"), "ord").alias("i"))
    big = once.select("file", "page", "xref", "i.*").filter((F.col("width") >= min_px) & (F.col("height") >= min_px))
    # One page of one file: as many rows as the page has pictures.
    order = Window.partitionBy("file", "page").orderBy("ord")
    return big.withColumn("index", F.row_number().over(order) - 1).select(
        "file", "page", "index", "xref", "ext", "width", "height"
    )


def doc_evidence(doc_pages: DataFrame, images: DataFrame, **thresholds: float) -> DataFrame:
    """Evidence rows of a document: one text row per clean page, one row per usable image on any page.

    ``doc_pages`` has (file, page, text, fonts_missing); ``images`` comes from :func:`usable_images`.
    """
    name = F.regexp_replace("file", r"^.*/", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    page = F.col("page").cast("string")
    base = [
        F.concat(stem, F.lit("-p"), page).alias("record_id"),
        F.concat(F.lit("pdf://"), F.col("file"), F.lit("#page="), page).alias("source_uri"),
    ]
    tail = [
        F.lit("pdf").alias("method"), F.lit(CLEAN_CONFIDENCE).alias("confidence"), F.lit(False).alias("absence"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("ts"),
    ]
    clean = ~garbled_flag(F.col("text"), F.col("fonts_missing"), **thresholds) & ~t.is_blank(F.col("text"))
    texts = doc_pages.filter(clean).select(
        *base, F.lit(0).cast("bigint").alias("seq"), F.lit("text").alias("field"), t.strip(F.col("text")).alias("value"), *tail
    )
    number = F.col("index").cast("string")
    media = F.concat(F.lit("media/"), stem, F.lit("_p"), page, F.lit("_img"), number, F.lit("."), F.col("ext"))
    pictures = images.select(
        *base, (F.col("index") + 1).cast("bigint").alias("seq"), F.concat(F.lit("image_"), number).alias("field"),
        media.alias("value"), *tail,
    )
    return texts.unionByName(pictures).select(
        "record_id", "seq", "field", "value", "source_uri", "method", "confidence", "absence", "ts"
    )


def ocr_pages(doc_pages: DataFrame, **thresholds: float) -> DataFrame:
    """(file, page) of every page whose text must be read again; one row per page, so no document is too long."""
    return doc_pages.filter(garbled_flag(F.col("text"), F.col("fonts_missing"), **thresholds)).select("file", "page")
