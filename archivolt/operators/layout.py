"""Squarified treemaps (T11): one group of sized items fills a box."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _worst(areas: list[float], side: float) -> float:
    total = sum(areas)
    thick = total / side
    return max(max(thick * thick / a, a / (thick * thick)) for a in areas)


def squarified(sizes: list[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """(x, y, w, h) of each size, in order of size, largest first; sizes are above 0.

    Rows along the shorter side take items while their worst ratio does not grow.
    """
    total = sum(sizes)
    areas = [s * width * height / total for s in sorted(sizes, reverse=True)]
    out, x, y, w, h, start = [], 0.0, 0.0, width, height, 0
    while start < len(areas):
        side, end = min(w, h), start + 1
        if side <= 0:
            out += [(min(x, width), min(y, height), 0.0, 0.0)] * (len(areas) - start)
            break
        while end < len(areas) and _worst(areas[start : end + 1], side) <= _worst(areas[start:end], side):
            end += 1
        thick, at = sum(areas[start:end]) / side, 0.0
        for a in areas[start:end]:
            long = a / thick
            box = (x, y + at, thick, long) if w >= h else (x + at, y, long, thick)
            out.append((*box[:2], max(0.0, min(box[2], width - box[0])), max(0.0, min(box[3], height - box[1]))))
            at += long
        x, w, y, h = (x + thick, w - thick, y, h) if w >= h else (x, w, y + thick, h - thick)
        start = end
    return out


def treemap(df: DataFrame, group: str, key: str, size: str, width: float, height: float) -> DataFrame:
    """(group, key, x, y, w, h) of items of size above 0, ties by key. Groups are small: what one picture shows."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key], ascending=[False, True])
        boxes = squarified(pdf[size].tolist(), width, height)
        return pd.DataFrame({group: pdf[group].values, key: pdf[key].values} | {c: [b[i] for b in boxes] for i, c in enumerate("xywh")})

    return df.where(f"`{size}` > 0").select(group, key, size).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, x double, y double, w double, h double")
