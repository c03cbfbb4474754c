"""Bounded, repeatable samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 31


def folded(doc_id: str, folds: int):
    """The fold of a document: crc32 of its id as text (null: of the empty text) modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def thinned(rows: DataFrame, key: list, most: int, text: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """About ``most`` rows of ``rows``, chosen by a hash of ``key``; all if they are fewer.

    With a ``text`` column its bytes are bounded, too, about ``most_bytes``. The share is set from
    a count, so each task drops rows as it reads them and what is kept doesn't grow with the table,
    but for rows of one key, which stay or go together. Thinning again needs another key: rows that
    one hash has let through pass the same hash with a larger share.
    """
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    n, held = rows.agg(F.count("*"), size).first()
    share = min(most / max(n, 1), most_bytes / max(held, 1))
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(*key), F.lit(_SPAN)) < F.lit(int(_SPAN * share)))
