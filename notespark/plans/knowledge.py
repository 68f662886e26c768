"""From page texts to placed entries: the ingest plan for all documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import headers as H, outline as O
from ..session import staged


def extract_entries(pages: DataFrame, styled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected header counts) of all documents.

    The headers are staged, verified and numbered: they are narrow, and everything but the final
    cut of the texts is computed from them.
    """
    verified = staged(H.verify_page_headers(H.header_candidates(pages), styled), "headers")
    headers = staged(H.number_blocks(verified.filter("accepted")), "blocks")
    numbered = headers.filter("kind = 'numbered'").select(
        "doc_id", F.col("block").alias("pos"), "type", "number", "name", "page")
    named = H.set_ids(numbered, ["doc_id"])
    bodies = H.cut_entries(pages, headers).withColumnRenamed("block", "pos")
    entries = named.join(bodies, ["doc_id", "pos"]).select(
        "doc_id", "pos", F.lit("numbered").alias("kind"), "type", "number",
        F.split("number", r"\.")[0].cast("int").alias("chapter"), "name", "page", "text", "proof", "id")
    return entries, H.rejected(verified, ["doc_id"])


def extract_knowledge(pages: DataFrame, styled: DataFrame, outline_raw: DataFrame
                      ) -> tuple[DataFrame, DataFrame]:
    """(entries with their section, outline nodes) of all documents."""
    entries, _ = extract_entries(pages, styled)
    return O.choose_tree(staged(entries, "entries"), O.outline_keys(outline_raw))
