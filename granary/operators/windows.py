"""Texts cut into windows of words, as a projection: nothing is shuffled, no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words: the blank and the control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def plain_words(text: Column | str) -> Column:
    """Words as they are written, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS), "")


def word_windows(docs: DataFrame, text: str = "text", size: int = 200, overlap: int = 40) -> DataFrame:
    """The other columns of docs with chunk_index, n_words and content, a row for each window of `size` words; `overlap` of them begin the next.

    A text of `size` words or fewer is one window, one without words has none; the last window has at most `size` words and
    always some that no other has. Words are joined by a blank. A row holds its text's windows while it is taken apart.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step, rest = size - overlap, [c for c in docs.columns if c != text]
    w = docs.select(*rest, plain_words(text).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - size, F.lit(0)) + (step - 1), F.lit(step))
    cut = w.select(*rest, F.posexplode(F.transform(starts, lambda s: F.slice("_words", s + 1, size))).alias("chunk_index", "_window"))
    return cut.select(*rest, "chunk_index", F.size("_window").alias("n_words"), F.array_join("_window", " ").alias("content"))
