"""Outcome tables: read, checked by quality, cut to the people and visits asked for, with an account of what was left out and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varimesh.functions import transforms
from varimesh.operators.tables import audit, finite, varying

from .tables import numeric_only, vertices

KINDS = ("voxel", "vertex", "corrmat", "roi", "external")


@dataclass
class Outcomes:
    """``df`` has ``iid, eid`` and the outcomes ``names`` (one array column ``y`` for images); ``dropped`` is ``(reason, n)``; ``mask`` the places of images that vary."""

    df: DataFrame
    names: list[str]
    dropped: DataFrame
    mask: DataFrame | None


def _mean(column: str, df: DataFrame) -> Column:
    """A number, or the mean of an array of them."""
    if df.schema[column].dataType.typeName() != "array":
        return F.col(column).cast("double")
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.nullif(F.size(column).cast("double"), F.lit(0.0))


def load_outcomes(
    table: DataFrame, kind: str, *, keys: tuple[str, str] = ("participant_id", "session_id"), column: str = "y", correlation: str | None = None, least_correlation: float = 0.8,
    frames: str | None = None, least_frames: float = 375, quality: DataFrame | None = None, quality_variable: str | None = None, subjects: DataFrame | None = None,
    events: DataFrame | None = None, related: DataFrame | None = None, pregnancy: DataFrame | None = None, address: DataFrame | None = None,
    transform: str = "none", whole_sample: bool = False, order: int | None = None,
) -> Outcomes:
    """The outcomes of one kind after the whole chain of checks.

    Images (``voxel``, ``vertex``, ``corrmat``) are arrays in ``column``; a vertex array is cut to the mesh of ``order``. ``roi`` and ``external`` take every numeric column. A row goes when an outcome is missing or
    not finite; when registration falls short (voxels: ``correlation``, a number or an array whose mean counts) or there are too few ``frames`` (correlation matrices); when its key did not pass ``quality``
    (``quality_variable`` is '1'); or when it is not among ``subjects`` (``iid``), ``events`` (``eid``) or those with relatedness values (``related``, ``iid``). One pass counts each reason on all rows; null counts as failing.
    ``pregnancy`` and ``address`` (``iid, eid`` and ``preg_id`` or ``home_id``) are looked up, null where absent. ``transform`` is that of the design (``center``, ``std``, ``logn``, ``log10``, ``ranknorm``), over all
    rows that have an outcome with ``whole_sample`` and over those that stay without it; for columns only. Ids asked for twice count once; a key that a lookup has twice takes the smallest id.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of outcomes {kind}")
    image = kind in ("voxel", "vertex", "corrmat")
    if image and transform != "none":
        raise ValueError("outcomes in an array are transformed where they are fitted")
    df = table.withColumnsRenamed({keys[0]: "iid", keys[1]: "eid"})
    extra = [c for c in (correlation, frames) if c]
    if image:
        y = F.slice(column, 1, vertices(order)) if kind == "vertex" and order is not None else F.col(column)
        df, names = df.select("iid", "eid", *extra, y.alias("y")), ["y"]
        whole = F.coalesce(finite("y"), F.lit(False))
    else:
        df = numeric_only(df, ["iid", "eid", *extra])
        names = [c for c in df.columns if c not in ("iid", "eid", *extra)]
        inf = float("inf")
        good = [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) & (F.abs(F.col(f"`{c}`").cast("double")) < inf) for c in names]
        whole = F.forall(F.array(*good), lambda x: x) if good else F.lit(True)
    filters: dict[str, Column] = {"missing outcome": whole}
    if kind == "voxel" and correlation:
        filters["registration"] = _mean(correlation, df) >= least_correlation
    if kind == "corrmat" and frames:
        filters["frames"] = F.col(frames) >= least_frames
    found = [
        ("quality", None if quality is None else quality.withColumnsRenamed({keys[0]: "iid", keys[1]: "eid"}).where(F.col(quality_variable).cast("string") == "1"), ["iid", "eid"]),
        ("subject", subjects, ["iid"]), ("event", events, ["eid"]), ("relatedness", related, ["iid"]),
    ]
    for name, ids, on in found:
        if ids is not None:
            flag = f"_{name}"
            df = df.join(ids.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left")
            filters[name] = F.col(flag)
    if transform != "none" and whole_sample:
        df = _transformed(df, names, transform, whole)
    kept, dropped = audit(df, filters)
    kept = kept.select("iid", "eid", *[F.col(f"`{n}`") for n in names])
    if transform != "none" and not whole_sample:
        kept = _transformed(kept, names, transform, F.lit(True))
    for side, name, on in ((pregnancy, "preg_id", ["iid", "eid"]), (address, "home_id", ["iid", "eid"])):
        if side is not None:
            side = side.withColumnsRenamed({keys[0]: "iid", keys[1]: "eid"})
            kept = kept.join(side.groupBy(*on).agg(F.min(name).alias(name)), on, "left")
    return Outcomes(kept, names, dropped, varying(kept, "y") if image else None)


def _transformed(df: DataFrame, names: list[str], how: str, among: Column) -> DataFrame:
    """The outcomes transformed over the rows ``among``; others are null there."""
    df = df.withColumns({n: F.when(among, F.col(f"`{n}`")) for n in names})
    df = transforms.scale(df, names, how)
    return df.withColumns({n: F.col(f"`{n}_{how}`") for n in names}).drop(*[f"{n}_{how}" for n in names])
