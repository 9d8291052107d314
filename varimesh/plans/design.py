"""Design matrices from a spec.

Columns come out in a fixed order: continuous variables by transform, categorical ones, interactions, the intercept. Names of generated columns are part of
the contract: ``<variable>_<level>``, ``<variable>_<transform>``, ``<variable>_bf<k>``, ``a__b``, ``Intercept``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimesh.functions import splines as sp
from varimesh.functions import transforms as tr
from varimesh.operators.linear import gram, independent_columns
from varimesh.operators.tables import missing_counts

from .spec import Spec, Variable

ORDER = ("center", "std", "logn", "log10", "ranknorm", "winsorize", "delta", "quadratic", "splines", "none")


@dataclass
class Design:
    df: DataFrame
    columns: list[str]
    mapping: dict[str, list[str]]
    dropped: list[str] = field(default_factory=list)
    missing: DataFrame | None = None


def _continuous(df: DataFrame, v: Variable, spec: Spec) -> tuple[DataFrame, list[str]]:
    c = v.label
    if v.transform in ("center", "std", "logn", "log10", "ranknorm"):
        return tr.scale(df, [c], v.transform), [f"{c}_{v.transform}"]
    if v.transform == "winsorize":
        return tr.winsorize(df, c, *v.winsorize), [f"{c}_winsorized"]
    if v.transform == "delta":
        return tr.delta(df, c, spec.subject, spec.visit), [f"{c}_baseline", f"{c}_delta"]
    if v.transform == "quadratic":
        return tr.quadratic(df, c), [f"{c}_main", f"{c}_quadratic"]
    if v.transform == "splines":
        ends = v.spline.ends or list(df.agg(F.min(c), F.max(c)).first())
        knots = v.spline.knots
        if isinstance(knots, str):
            knots = tr.hazen(df, c, [0, 25, 50, 75, 100] if v.spline.kind == "nsk" else [25, 50, 75])
        b = sp.basis((float(ends[0]), float(ends[1])), knots, v.spline.kind, v.spline.method, v.spline.powers, v.spline.points)
        return sp.add_basis(df, c, b)
    return df, [c]


def build(df: DataFrame, spec: Spec, drop_missing: bool = True, drop_dependent: bool = True) -> Design:
    """The design of ``df``: its id columns and the columns of the spec. Rows with a missing variable are dropped and counted.

    ``df`` should be a saved or cached table: each transform reads it for its constants.
    """
    names = {v.name: v.label for v in spec.variables if v.rename}
    df = df.withColumnsRenamed(names)
    used = [v.label for v in spec.variables]
    df = tr.blank_missing(df, used)
    missing = missing_counts(df, used) if used else None
    if drop_missing and used:
        df = df.dropna(how="any", subset=used)
    columns, mapping = [], {}
    numeric = [v for v in spec.variables if v.kind == "continuous"]
    for v in sorted(numeric, key=lambda v: ORDER.index(v.transform)):
        df = df.withColumn(v.label, F.col(v.label).cast("double"))
        df, mapping[v.label] = _continuous(df, v, spec)
        columns += mapping[v.label]
    for v in (v for v in spec.variables if v.kind == "categorical"):
        df, mapping[v.label] = tr.dummies(df, v.label, v.reference)
        columns += mapping[v.label]
    for term in tr.lower_order(spec.interactions):
        df, made = tr.interaction(df, [mapping[v] for v in term])
        mapping["__".join(term)] = made
        columns += made
    if spec.transform_global != "none":
        df = tr.scale(df, columns, spec.transform_global)
        columns = [f"{c}_{spec.transform_global}" for c in columns]
        mapping = {k: [f"{c}_{spec.transform_global}" for c in v] for k, v in mapping.items()}
    if spec.intercept:
        df = df.withColumn("Intercept", F.lit(1.0))
        columns.append("Intercept")
        mapping["Intercept"] = ["Intercept"]
    gone: list[str] = []
    if drop_dependent and columns:
        kept = independent_columns(gram(df, columns, []).xx)
        gone = [c for i, c in enumerate(columns) if i not in kept]
        columns = [columns[i] for i in kept]
    return Design(df, columns, mapping, gone, missing)
