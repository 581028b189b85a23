"""One row per sentence or paragraph.

Text is the widest column, so callers select what they need before the explosion; all steps are
narrow and run in one stage with the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.labels import bad_paragraph
from cuemill.functions.text import min_words, sentence_array, strip
from cuemill.functions.web import page_blocks
from cuemill.lexicons import PARAGRAPH_JUNK


def sentences(
    df: DataFrame, text: str = "text", min_word_count: int = 5, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, ``pos`` and stripped ``sentence`` of at least ``min_word_count`` words.

    ``pos`` counts all pieces, so ``(key, pos)`` gives the corpus order that rows lack.
    """
    # Separators swallow all white space between pieces, so stripping the text strips each piece.
    pieces = df.select(*keep, F.posexplode(sentence_array(strip(text))).alias("pos", "sentence"))
    return pieces.filter(min_words("sentence", min_word_count)) if min_word_count > 0 else pieces


def html_paragraphs(
    df: DataFrame, key: str = "page_id", html: str = "html",
    phrases: Sequence[str] = PARAGRAPH_JUNK, min_word_count: int = 6, blocks: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``pos`` and ``text`` of each paragraph that is neither boilerplate nor a fragment."""
    texts = page_blocks(html, blocks)
    rows = df.select(key, *keep, F.posexplode(texts).alias("pos", "text"))
    return rows.filter(min_words("text", min_word_count) & ~bad_paragraph("text", phrases))


def html_article_text(
    df: DataFrame, key: str = "page_id", url: str = "url", title: str = "title",
    html: str = "html", phrases: Sequence[str] = PARAGRAPH_JUNK, min_word_count: int = 6,
    blocks: bool = True,
) -> DataFrame:
    """One row per page with its whole text; commas and line breaks become blanks.

    A page is one row, so its paragraphs are cleaned and joined as an array inside the row: no
    shuffle, whatever the page's size.
    """
    texts = page_blocks(html, blocks)
    kept = F.filter(texts, lambda t: min_words(t, min_word_count) & ~bad_paragraph(t, phrases))
    return df.select(
        key, F.col(url).alias("url"),
        F.translate(F.coalesce(F.col(title), F.lit("")), ",", " ").alias("title"),
        F.translate(F.array_join(kept, "\n"), "\n,", "  ").alias("text"))
