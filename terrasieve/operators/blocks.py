"""Three-dimensional arrays as square blocks, each a row with all its layers, and series gathered from them by row and column.

A long table of (layer, row, col, value) becomes dense blocks once. Requests are first brought to distinct
places, of which a block has some thousands at most, whatever is asked for; each block is then read once and gives
the series of all its places, and requests meet them by place. Values that are null or missing
come back as null; places outside all blocks have a null series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block.
SIDE = 64


def as_blocks(cube: DataFrame, layer: str, row: str, col: str, value: str, side: int = SIDE) -> DataFrame:
    """(block_row, block_col, layers, data): 64-bit floats by layer, row and column, NaN for none; of repeated places the largest value stays."""
    at = [F.floor(F.col(c) / side).cast("int") for c in (row, col)]
    inside = [F.pmod(F.col(c), F.lit(side)).cast("int") for c in (row, col)]
    long = cube.groupBy(at[0].alias("block_row"), at[1].alias("block_col"), F.col(layer).cast("long").alias("layer"), inside[0].alias("r"), inside[1].alias("c")).agg(F.max(F.col(value).cast("double")).alias("v"))

    def dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        layers, at = np.unique(rows["layer"].to_numpy(), return_inverse=True)
        data = np.full((len(layers), side, side), np.nan)
        data[at, rows["r"], rows["c"]] = rows["v"].to_numpy(float)
        return pd.DataFrame({"block_row": [key[0]], "block_col": [key[1]], "layers": [layers.tolist()], "data": [data.tobytes()]})

    placed = long.where("block_row is not null and block_col is not null and layer is not null")
    return placed.groupBy("block_row", "block_col").applyInPandas(dense, "block_row int, block_col int, layers array<long>, data binary")


def gathered(requests: DataFrame, blocks: DataFrame, row: str, col: str, side: int = SIDE, name: str = "series") -> DataFrame:
    """requests with the series of their place: structs of layer and value, in order of layer."""
    at = [F.floor(F.col(c) / side).cast("int") for c in ("_row", "_col")]
    places = requests.select(F.col(row).cast("long").alias("_row"), F.col(col).cast("long").alias("_col")).where("_row is not null and _col is not null").distinct()
    wanted = places.withColumns({"block_row": at[0], "block_col": at[1]})

    def of_block(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(block):
            layers = block["layers"].iloc[0]
            data = np.frombuffer(block["data"].iloc[0]).reshape(-1, side, side)
            values = data[:, asked["_row"].to_numpy() % side, asked["_col"].to_numpy() % side].T
            out = [(r, c, [float(x) for x in v]) for r, c, v in zip(asked["_row"], asked["_col"], values)]
            return pd.DataFrame(out, columns=["_row", "_col", "values"]).assign(layers=[list(layers)] * len(out))
        return pd.DataFrame(out, columns=["_row", "_col", "values", "layers"])

    found = wanted.groupBy("block_row", "block_col").cogroup(blocks.groupBy("block_row", "block_col")).applyInPandas(of_block, "_row long, _col long, values array<double>, layers array<long>")
    series = F.zip_with("layers", "values", lambda t, v: F.struct(t.alias("layer"), F.when(~F.isnan(v), v).alias("value")))
    keyed = found.select("_row", "_col", series.alias(name))
    return requests.join(keyed, (F.col(row) == F.col("_row")) & (F.col(col) == F.col("_col")), "left").drop("_row", "_col")
