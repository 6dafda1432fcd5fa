"""Structures in images: ink, boxes, their merging, and what is accepted of recognised SMILES.

An image is one row of a task; its pixels stay in one Arrow batch and are searched with arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.functions.core import once
from corundum.functions.smiles import structure
from corundum.functions.values import strip
from corundum.schemas import MISSING

Box = tuple[int, int, int, int]
NO_SMILES = ("none", "null", "nan", "invalid", "<invalid>")


def ink(rgb: np.ndarray) -> np.ndarray:
    high, low = rgb.max(axis=2).astype(int), rgb.min(axis=2).astype(int)
    return (high < 225) | ((low < 180) & (high - low > 30))


def colored_ink(rgb: np.ndarray) -> np.ndarray:
    high, low = rgb.max(axis=2).astype(int), rgb.min(axis=2).astype(int)
    return (high <= 250) & (high - low > 45)


def grid_components(active: np.ndarray) -> np.ndarray:
    """Labels of a boolean grid's components (8 neighbours), 0 where it is False: every cell takes
    the least label around it until none changes, jumping along labels."""
    h, w = active.shape
    label = np.where(active, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(np.where(active, label, h * w + 1), 1, constant_values=h * w + 1)
        least = np.min([padded[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0)
        new = np.where(active, least, 0)
        jump = np.concatenate(([0], new.ravel()))
        new = np.where(active, np.minimum(new, jump[new]), 0)
        if (new == label).all():
            return label
        label = new


# Sides and area of a box, the shares of an image that a frame takes, and how near, in
# pixels, boxes are that belong together: in both directions, or in one if they overlap in the other.
LEAST_SIDES, LEAST_AREA, FRAME = (28, 20), 900, (0.95, 0.85)
NEAR, BESIDE, ABOVE, OVERLAP = 10, 28, 22, 0.45


def keep_boxes(boxes: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Which boxes (rows of x0, y0, x1, y1) are large enough and no frame of the image."""
    sides = boxes[:, 2:] - boxes[:, :2]
    frame = (sides > np.array(size) * FRAME).all(axis=1)
    return (sides >= LEAST_SIDES).all(axis=1) & (sides.prod(axis=1) >= LEAST_AREA) & ~frame


def keep_box(box: Box, size: tuple[int, int]) -> bool:
    return bool(keep_boxes(np.array([box]), size)[0])


def close_to(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the others belong to a box."""
    between = np.maximum(box[:2], others[:, :2]) - np.minimum(box[2:], others[:, 2:])  # below 0 where they overlap
    shorter = np.minimum(box[2:] - box[:2], others[:, 2:] - others[:, :2])
    gap, share = np.maximum(between, 0), np.maximum(-between, 0) / np.maximum(shorter, 1)
    return (gap <= NEAR).all(axis=1) | ((gap[:, 0] <= BESIDE) & (share[:, 1] > OVERLAP)) | ((gap[:, 1] <= ABOVE) & (share[:, 0] > OVERLAP))


def boxes_close(a: Box, b: Box) -> bool:
    return bool(close_to(np.array(a), np.array([b]))[0])


def merge_boxes(boxes: list[Box], size: tuple[int, int]) -> list[Box]:
    """Boxes that belong together as one, until none do. In each pass the first box takes up, in
    order, what is close to what it has grown to; what stays apart is left for the next first."""
    rows = np.array(boxes, np.int64).reshape(-1, 4)
    while True:
        out, todo = [], rows
        while len(todo):
            box, todo = todo[0], todo[1:]
            taken, at = np.zeros(len(todo), bool), 0
            while at < len(todo) and (near := close_to(box, todo[at:])).any():
                k = at + int(near.argmax())
                box = np.concatenate((np.minimum(box[:2], todo[k, :2]), np.maximum(box[2:], todo[k, 2:])))
                taken[k], at = True, k + 1
            out.append(box)
            todo = todo[~taken]
        merged = np.array(out, np.int64).reshape(-1, 4)
        same = len(merged) == len(rows)
        rows = merged[keep_boxes(merged, size)] if len(merged) else merged
        if same:
            return [tuple(map(int, r)) for r in rows]


def find_boxes(rgb: np.ndarray, mask_of: Callable[[np.ndarray], np.ndarray], *, cell: int, least: int, most: int) -> list[Box]:
    """Boxes around connected ink, by row: every other pixel of a cell is looked at, a cell with
    least of ink is active, a component's box is drawn around its ink with a margin."""
    height, width = rgb.shape[:2]
    mask = mask_of(rgb)
    gh, gw = -(-height // cell), -(-width // cell)
    full = np.zeros((gh * cell, gw * cell), bool)
    full[:height, :width] = mask
    active = full.reshape(gh, cell, gw, cell)[:, ::2, :, ::2].sum(axis=(1, 3)) >= least
    labels = grid_components(active)
    boxes = []
    for k in np.unique(labels[labels > 0]):
        gy, gx = np.nonzero(labels == k)
        x0, y0, x1, y1 = gx.min() * cell, gy.min() * cell, min(width, (gx.max() + 1) * cell), min(height, (gy.max() + 1) * cell)
        ys, xs = np.nonzero(mask[y0:y1, x0:x1])
        if len(xs):
            box = (int(max(0, x0 + xs.min() - 8)), int(max(0, y0 + ys.min() - 8)), int(min(width, x0 + xs.max() + 8)), int(min(height, y0 + ys.max() + 8)))
            if keep_box(box, (width, height)):
                boxes.append(box)
    return sorted(merge_boxes(boxes, (width, height)), key=lambda b: (b[1], b[0]))[:most]


def structure_boxes(rgb: np.ndarray) -> list[Box]:
    """Coloured structures if two large ones are there, else any ink."""
    colored = find_boxes(rgb, colored_ink, cell=8, least=1, most=36)
    if sum(b[2] - b[0] >= 70 and b[3] - b[1] >= 55 for b in colored) >= 2:
        return colored
    return find_boxes(rgb, ink, cell=12, least=2, most=24)


def box_confidence(area: Column, image_area: Column) -> Column:
    return F.when(area > image_area * 0.4, 0.55).when(area > image_area * 0.08, 0.72).otherwise(0.62)


def detect(images: DataFrame) -> DataFrame:
    """task_id, box_index, bbox, confidence of images (task_id, width, height, pixels: RGB bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rgb = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                out += [(r.task_id, i, [float(x) for x in b], float((b[2] - b[0]) * (b[3] - b[1])), float(r.width * r.height)) for i, b in enumerate(structure_boxes(rgb))]
            yield pd.DataFrame(out, columns=["task_id", "box_index", "bbox", "area", "image_area"])

    found = images.select("task_id", "width", "height", "pixels").mapInPandas(run, "task_id string, box_index int, bbox array<double>, area double, image_area double")
    return found.select("task_id", "box_index", "bbox", box_confidence(F.col("area"), F.col("image_area")).alias("confidence"))


def crop_problem(width: Column, height: Column) -> Column:
    """Why a crop can't be recognised; null if it can."""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    one = F.lit(1)
    ratio = F.greatest(width / F.greatest(height, one), height / F.greatest(width, one))
    return F.when((width < 32) | (height < 32), F.concat(F.lit("crop is too small: "), size)).when(width * height < 2000, F.concat(F.lit("crop area is too small: "), size)).when(ratio > 7.5, F.concat(F.lit("crop aspect ratio is too extreme: "), size))


def clean_smiles(c: Column) -> Column:
    bare = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(bare).isin(*NO_SMILES), F.lit("")).otherwise(bare)


def clean_model_smiles(c: Column) -> Column:
    """A structure as a model tells it; its mark for none is the mark for missing."""
    bare = strip(F.coalesce(c, F.lit("")))
    return F.when(F.upper(bare) == MISSING, F.lit("")).otherwise(bare)


def quality_flags(smiles: Column, confidence: Column) -> Column:
    return F.array_compact(F.array(F.when(confidence < 0.5, "low_confidence"), F.when(F.contains(smiles, F.lit("*")), "wildcard_or_r_group"), F.when(F.contains(smiles, F.lit(".")), "multiple_components_or_fragment")))


def validity(smiles: Column, checked: Column | None = None) -> Column:
    """valid, invalid or not_checked. checked is what a toolkit says (null: it wasn't asked); without
    it the text is parsed."""
    told = checked if checked is not None else structure(smiles)["status"] == "valid"
    return F.when((smiles == "") | F.contains(smiles, F.lit("*")), "invalid").when(told.isNull(), "not_checked").when(told, "valid").otherwise("invalid")


def accept(records: DataFrame) -> DataFrame:
    """records with final_smiles, smiles_source and validation_status: the model's structure if it
    is valid, else the recogniser's, else the model's for review if none could be checked; none where
    a scaffold's substituents are open. records: model_smiles, model_validity, recognised_smiles,
    recognised_validity, open_scaffold."""
    c = F.col
    by_model, by_other = c("model_validity") == "valid", c("recognised_validity") == "valid"
    review = (c("model_validity") == "not_checked") & (c("model_smiles") != "")
    shut = F.coalesce("open_scaffold", F.lit(False))
    pick = lambda a, b, r, none: F.when(shut, F.lit(none)).when(by_model, a).when(by_other, b).when(review, r).otherwise(F.lit(none))
    verdict = F.struct(
        pick(c("model_smiles"), c("recognised_smiles"), c("model_smiles"), MISSING).alias("final_smiles"),
        pick(F.lit("vision_chemical_ocr_agent"), F.lit("molscribe_fallback"), F.lit("vision_chemical_ocr_agent"), "none").alias("smiles_source"),
        pick(F.lit("accepted"), F.lit("accepted"), F.lit("needs_review"), "rejected").alias("validation_status"),
    )
    return once(records, verdict, "verdict").select("*", "verdict.*").drop("verdict")
