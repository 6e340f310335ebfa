"""Code points of many texts in one array, and the samples that classifiers learn from."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def is_letter(codes: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(codes, 0xFFFF)]
    rare = codes > 0xFFFF
    if rare.any():
        kinds, where = np.unique(codes[rare], return_inverse=True)
        out[rare] = np.array([chr(c).isalpha() for c in kinds.tolist()])[where]
    return out


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with a blank at both ends, and where each text starts and ends.

    Between texts stands a zero; zeros inside become blanks.
    """
    joined = "".join([f" {t} \0" for t in (t.replace("\0", " ") for t in texts)]).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.flatnonzero(codes == 0)
    return codes, np.r_[0, ends[:-1] + 1], ends


def take_by_hash(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows, the first by a hash of doc_id: a bounded sample that does not depend on partitions."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
