"""Bring extracted samples into a domain's record form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.functions.values import field_value, is_missing, pdf_identifier
from corundum.schemas import MISSING, Domain


def normalize_samples(d: Domain, samples: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and the domain's columns in order, each from its own column or the aliases that are
    there (the last one wins), canonical; MISSING where there is none. Other columns go."""
    sources = {c: [s for s in samples.columns if d.aliases.get(s, s) == c] for c in d.columns}
    value = lambda c: field_value(d, c, F.col(f"`{sources[c][-1]}`").cast("string")) if sources[c] else F.lit(MISSING)
    return samples.select(*keep, *(value(c).alias(c) for c in d.columns))


def fill_dimensions(samples: DataFrame) -> DataFrame:
    """A length stands for missing width and depth; without one, a width for a missing depth."""
    length, width, depth = F.col("length"), F.col("width"), F.col("depth")
    new_width = F.when(~is_missing(length) & is_missing(width), length).otherwise(width)
    new_depth = F.when(is_missing(depth), F.when(~is_missing(length), length).when(~is_missing(width), width)).otherwise(depth)
    return samples.withColumns({"width": new_width, "depth": F.coalesce(new_depth, depth)})


def drop_setup_rows(samples: DataFrame, *, by: tuple[str, ...] = ("pdf",)) -> DataFrame:
    """Rows without Km and Vmax go where any row of the same article has one. The articles that
    have are found by an aggregation and met by a join, so no article is gathered in one task."""
    kinetic = ~is_missing(F.col("km_value")) | ~is_missing(F.col("vmax_value"))
    keys = {k: f"{k}_with_kinetic" for k in by}
    have = samples.where(kinetic).select(*(F.col(k).alias(v) for k, v in keys.items())).distinct().withColumn("has_kinetic", F.lit(True))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(v)) for k, v in keys.items()))
    return samples.join(have, same, "left").where(kinetic | F.col("has_kinetic").isNull()).drop("has_kinetic", *keys.values())


def finalize(d: Domain, samples: DataFrame, *, keep: tuple[str, ...] = ("pdf",)) -> DataFrame:
    out = normalize_samples(d, samples, keep=keep)
    return drop_setup_rows(fill_dimensions(out), by=keep) if d.key == "nanozymes" else out


def sample_frame(d: Domain, samples: DataFrame, pdf_name: Column) -> DataFrame:
    """The prediction table of one or many files: the domain's columns and pdf."""
    named = samples.withColumn("pdf", pdf_identifier(d, pdf_name))
    return finalize(d, named).select(*(F.col(f"`{c}`") for c in d.columns), "pdf")


def rows_of_article(d: Domain, frame: DataFrame, pdf: str) -> DataFrame:
    """An article's rows with all the domain's columns."""
    have = lambda c: F.col(f"`{c}`").cast("string") if c in frame.columns else F.lit(MISSING)
    return frame.where(F.col("pdf") == pdf).select(*(have(c).alias(c) for c in d.columns))
