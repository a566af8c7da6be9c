"""What the operators share: the shared work folder, null handling and word rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaquarry.storage import checkpoint_base, materialise, work_path

__all__ = ["WORD", "checkpoint_base", "crc_fold", "materialise", "release_memory", "text_of", "work_path"]

#: White space of every word rule here: space and the five controls from tab to carriage return.
#: ``bytes.split()`` and ``bytes.lower()`` follow the same ASCII rule.
WORD = r"[^\x20\x09-\x0D]+"


def release_memory() -> None:
    """Give what a finished task used back to the system: Python workers are kept for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
