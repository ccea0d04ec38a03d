"""Quality of instance masks: parts of the foreground, holes inside it, and the gate that crops must pass.

A mask is cut into runs of equal pixels, row by row. Runs that touch from one row to
the next are linked, and all masks of a slice are labelled together by a few
rounds of array operations. Pixels touch at their sides, not at their corners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "fg_area long, n_parts long, largest_share double, hole_share double, n_significant long"

#: A slice is labelled at once when this many pixels have come together.
SLICE = 1 << 22


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component; ``a`` and ``b`` are the ends of links.

    Each round hangs every root below the smallest root it is linked with, so roots
    that still have links at least halve.
    """
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above


def measures(masks: list[np.ndarray]) -> pd.DataFrame:
    """The columns of ``FOUND`` of each two-dimensional boolean mask."""
    framed = [np.pad(m, 1) for m in masks]  # so that all that is outside a mask's foreground hangs together
    heights, widths = np.array([m.shape[0] for m in framed]), np.array([m.shape[1] for m in framed])
    pixels = np.concatenate([m.ravel() for m in framed])
    mask_of_row = np.repeat(np.arange(len(framed)), heights)
    width = widths[mask_of_row]
    row_start = np.concatenate([[0], np.cumsum(width)[:-1]])
    begins = np.empty(len(pixels), bool)
    begins[0] = True
    begins[1:] = pixels[1:] != pixels[:-1]
    begins[row_start] = True
    start = np.flatnonzero(begins)
    row = np.searchsorted(row_start, start, "right") - 1
    mask, on = mask_of_row[row], pixels[start]
    length = np.diff(np.append(start, len(pixels)))

    # Where a run begins, the run below it and the run above it; all overlaps of two rows begin at such a place.
    last = np.cumsum(heights) - 1
    first = last - heights + 1
    down, up = np.flatnonzero(row != last[mask]), np.flatnonzero(row != first[mask])
    below = np.searchsorted(start, start[down] + width[row[down]], "right") - 1
    above = np.searchsorted(start, start[up] - width[row[up]], "right") - 1
    a, b = np.concatenate([down, up]), np.concatenate([below, above])
    same = on[a] == on[b]
    root = joined(len(start), a[same], b[same])

    size = np.bincount(root, weights=length, minlength=len(start)).astype(np.int64)
    n = len(framed)
    fg = np.bincount(mask, weights=length * on, minlength=n).astype(np.int64)
    outer = size[root[np.searchsorted(start, row_start[first])]]
    holes = heights * widths - fg - outer
    return pd.DataFrame({"fg_area": fg, "holes": holes}).join(_parts(size, root, mask, on, fg, n)).pipe(_shares)


#: Of the foreground, the least share of a part that counts as significant.
SIGNIFICANT = 0.02


def _parts(size, root, mask, on, fg, n) -> pd.DataFrame:
    part = np.flatnonzero((root == np.arange(len(root))) & on)
    of = mask[part]
    largest = np.zeros(n, np.int64)
    np.maximum.at(largest, of, size[part])
    big = size[part] / fg[of] >= SIGNIFICANT
    return pd.DataFrame({"n_parts": np.bincount(of, minlength=n), "largest": largest, "n_significant": np.bincount(of[big], minlength=n)})


def _shares(found: pd.DataFrame) -> pd.DataFrame:
    found["largest_share"] = found.largest / np.maximum(found.fg_area, 1)
    found["hole_share"] = found.holes / np.maximum(found.fg_area + found.holes, 1)
    return found[["fg_area", "n_parts", "largest_share", "hole_share", "n_significant"]]


def _pixels(height, width, mask) -> np.ndarray:
    if mask is None or pd.isna(height) or pd.isna(width):
        return np.zeros((0, 0), bool)
    flat = np.frombuffer(mask, np.uint8)
    if len(flat) != int(height) * int(width):
        raise ValueError(f"a mask of {len(flat)} pixels can't be {int(height)} by {int(width)}")
    return flat.reshape(int(height), int(width)) != 0


def mask_quality(
    masks: DataFrame, keys: list[str], least_largest: float = 0.90, most_holes: float = 0.12, most_parts: int = 1
) -> DataFrame:
    """keys, the columns of ``FOUND``, ``reasons`` and ``ok`` of each mask (keys, height, width, mask: a byte a pixel, row by row, 0 is background).

    A null mask, or one without foreground, is ``empty_mask`` with zeros. Several rows of
    one key are judged apart. A mask whose bytes don't fill its size raises.
    """
    rows = masks.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("mask").alias("_m"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, at, pixels = [], 0, 0
            for i, (h, w, m) in enumerate(zip(batch._h, batch._w, batch._m, strict=True)):
                held.append(_pixels(h, w, m))
                pixels += held[-1].size
                if pixels >= SLICE or i == len(batch) - 1:
                    yield pd.concat([batch[keys].iloc[at : i + 1].reset_index(drop=True), measures(held)], axis=1)
                    held, at, pixels = [], i + 1, 0

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), FOUND])
    some = F.col("fg_area") > 0
    reasons = F.array_compact(
        F.array(
            F.when(~some, "empty_mask"),
            F.when(some & (F.col("largest_share") < least_largest), "largest_cc_too_small"),
            F.when(some & (F.col("hole_share") > most_holes), "interior_holes"),
            F.when(some & (F.col("n_significant") > most_parts), "too_many_fragments"),
        )
    )
    return rows.mapInPandas(judged, schema).withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
