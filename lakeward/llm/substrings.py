"""Removal of word passages that an earlier document has, by exact anchors.

The blocks of 25 words that are indexed are chosen by content (the least fingerprint
among a window's rolling blocks) and not by counting to 25: every rolling block is
fingerprinted, but only the chosen ones leave the task, where probing an index of
fixed blocks would send one row for each word of the corpus. The windows
of 50 words around equal blocks are then counted by two fingerprints of 64 bits each,
and runs of repeated windows are the maximal repeats; words are not compared.

Nulls and ties: a null text has no words; an empty table gives no rows; a very long text
is worked on in pieces; columns other than doc_id and text may have any name; a document without a doc_id comes after all
others and is no earlier document for any; documents of the same doc_id do not cover
each other. A document of fewer words than the window keeps them all. Words of other
documents count as they are, case and punctuation included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm import repeats

WINDOW = 50
BLOCK = 25


def deduplicated(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 and (``with_text``) kept."""
    rule = repeats.Rule(window, block, earlier=True, words=True)
    out = repeats.removal(docs, rule, lambda parts: repeats.compared(parts, rule), with_text)
    text = [F.col("kept").cast("string").alias("kept")] if with_text else []
    return out.select("doc_id", F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"), *text)
