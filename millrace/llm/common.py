"""What the operators share: tables in the shared folder, blocks of bounded size, components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.blocks import pair_blocks  # noqa: F401
from ..operators.linked import BATCH_ROWS, CLEAN, Forest, components, discard, give_back, lean, shared_folder, small_batches, stored  # noqa: F401


def id_remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(by))
