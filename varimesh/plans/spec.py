"""Job specs: what to model, read from JSON, TOML or keyword arguments into one checked form."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

TRANSFORMS = ("center", "std", "logn", "log10", "ranknorm", "winsorize", "delta", "quadratic", "splines", "none")
GLOBAL = ("center", "std", "logn", "log10", "ranknorm", "none")


@dataclass
class Spline:
    knots: list[float] | str = "quartiles"
    kind: str = "nsk"
    method: str = "svd"
    powers: list[int] = field(default_factory=list)
    ends: list[float] | None = None
    points: int = 101


@dataclass
class Variable:
    name: str
    kind: str = "continuous"
    rename: str | None = None
    transform: str = "none"
    reference: str | None = None
    winsorize: tuple[float, float] = (0.0, 100.0)
    spline: Spline = field(default_factory=Spline)
    of_interest: bool = False

    @property
    def label(self) -> str:
        return self.rename or self.name


@dataclass
class Spec:
    variables: list[Variable]
    interactions: list[tuple[str, ...]] = field(default_factory=list)
    intercept: bool = True
    transform_global: str = "none"
    outcomes: list[str] = field(default_factory=list)
    outcome_transform: str = "none"
    random: tuple[str, ...] = ("F", "S", "E")
    n_bins: int = 20
    n_perm: int = 0
    perm_kind: str = "none"
    fixed: str = "GLS"
    covariance: str = "analytic"
    n_pcs: int = 0
    subject: str = "iid"
    visit: str = "eid"
    random_est: str = "MOM"

    def __post_init__(self):
        seen = set()
        for v in self.variables:
            if v.label in seen:
                raise ValueError(f"{v.label} is named twice")
            seen.add(v.label)
            if v.transform not in TRANSFORMS:
                raise ValueError(f"unknown transform {v.transform} of {v.name}")
            if v.kind not in ("continuous", "categorical"):
                raise ValueError(f"unknown type {v.kind} of {v.name}")
            if v.reference is None:
                v.reference = "mode" if self.intercept else "none"
            v.winsorize = tuple(sorted(v.winsorize))
        if self.random_est not in ("MOM", "ML"):
            raise ValueError(f"unknown estimate of random effects {self.random_est}")
        if self.transform_global not in GLOBAL or self.outcome_transform not in GLOBAL:
            raise ValueError("unknown transform for all columns")
        for t in self.interactions:
            if unknown := [v for v in t if v not in seen]:
                raise ValueError(f"interaction with unknown {', '.join(unknown)}")
        self.random = (*[r for r in self.random if r != "E"], "E")
        self.variables += [Variable(f"pc_{i:02d}") for i in range(1, self.n_pcs + 1)]


def _variable(d: dict) -> Variable:
    s = dict(d.get("splines") or {})
    kind = s.get("type_spline", s.get("splineType", "nsk"))  # both spellings are in use
    spline = Spline(s.get("knots", "quartiles"), kind, s.get("method", "svd"), list(s.get("Xpowers", []) or []), s.get("minMax"))
    transform = d.get("transform") or ("splines" if d.get("splines") else "none")
    if isinstance(transform, (list, tuple)):
        if len(transform) > 1:
            raise ValueError(f"{d['name']} has more than one transform")
        transform = transform[0] if transform else "none"
    limits = (d.get("winsorize") or {}).get("minmax", (0.0, 100.0))
    return Variable(d["name"], d.get("type_var", "continuous"), d.get("name_custom"), transform, d.get("reference"), tuple(limits), spline, bool(d.get("of_interest", False)))


def from_dict(job: dict) -> Spec:
    """From the nested form of a JSON or TOML job."""
    p = job.get("params", job)
    fixed, advanced = p.get("fixed", {}), p.get("advanced", {})
    dependent = p.get("dependent", {})
    names = dependent.get("name", [])
    crossed = [tuple(i["vars"]) if isinstance(i, dict) else tuple(i) for i in fixed.get("interaction", [])]
    random = p.get("random", ["F", "S", "E"])
    return Spec(
        [_variable(v) for v in fixed.get("vars", [])], crossed, fixed.get("intercept", True), fixed.get("transform_global") or "none",
        [names] if isinstance(names, str) else list(names), dependent.get("transform") or "none", tuple(random), int(advanced.get("n_bins", 20)), int(advanced.get("n_perm", 0)),
        advanced.get("type_perm", "none"), str(advanced.get("type_fixed_est", "GLS")).upper(), advanced.get("type_cov", "analytic"), int(fixed.get("n_gpcs", 0)),
        random_est=str(advanced.get("type_random_est", "MoM")).upper(),
    )


def from_json(text: str) -> Spec:
    return from_dict(json.loads(text))


def from_toml(text: str) -> Spec:
    return from_dict(tomllib.loads(text))


def merged(spec: dict, **changes) -> dict:
    """A nested job with values replaced; keys are dotted paths with ``__`` between."""
    out = json.loads(json.dumps(spec))
    for path, value in changes.items():
        *parents, last = path.split("__")
        at = out
        for k in parents:
            at = at.setdefault(k, {})
        at[last] = value
    return out
