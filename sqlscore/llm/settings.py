"""Production parameters that the registered queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import functions as F

# target weights in parts: the dominant source is held down, two curated ones are raised
MIX_PARTS = {f"src{i}": {0: 12, 1: 8, 2: 8}.get(i, 4) for i in range(20)}
MIX_REST_PARTS = 4
MIX_BLOCK_ROWS = 16
N_SHARDS = 24


def toxicity_categories() -> dict:
    """The two given labels make three categories, in the order of the chain."""
    toxic, low_quality = F.col("toxic") == 1, F.col("quality") == 0
    return {"low_quality": low_quality, "toxic": toxic, "toxic_low_quality": toxic & low_quality}
