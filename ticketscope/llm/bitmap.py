"""A bitmap of hashed keys: of fixed size, so it may be sent to every worker whatever the number of keys."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = 64


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit for the leading `bits` bits of each key of a table of one column of hashes: 2**bits / 8 bytes."""
    name = keys.columns[0]
    page_bits = bits - PAGES.bit_length() + 1

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros(1 << page_bits, bool)
        slots = rows["slot"].to_numpy()
        page[slots & ((1 << page_bits) - 1)] = True
        return pd.DataFrame({"page": [int(slots[0]) >> page_bits], "held": [np.packbits(page, bitorder="little").tobytes()]})

    # A slot counts once however many keys share it, so the rows of a page are bounded by its slots.
    slots = keys.select(F.shiftrightunsigned(name, 64 - bits).alias("slot")).distinct().withColumn("page", F.shiftright("slot", page_bits))
    out = np.zeros((PAGES, (1 << page_bits) // 8), np.uint8)
    for row in slots.groupBy("page").applyInPandas(fill, "page long, held binary").toLocalIterator():
        out[row["page"]] = np.frombuffer(row["held"], np.uint8)
    return out.ravel()


def has(held: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each unsigned key may be among those of the bitmap; never false for one that is."""
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
