"""Plans: what to do with a pair of volumes, as named settings that inherit from one another."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from ..operators.gates import Gates


@dataclass(frozen=True)
class Prep:
    window: str | None = None
    clip: tuple[float, float] | None = None
    percentiles: tuple[float, float] | str | None = "auto"
    normalize: str = "none"
    smooth_mm: float | None = None

    def __post_init__(self) -> None:
        for pair in (self.clip, self.percentiles if isinstance(self.percentiles, tuple) else None):
            if pair and pair[0] >= pair[1]:
                raise ValueError(f"bounds are not in order: {pair}")


@dataclass(frozen=True)
class Stage:
    kind: str
    metric: str = "auto"
    n_resolutions: int = 4
    max_iterations: int = 512
    n_samples: int = 4096
    grid_mm: float = 20.0
    bending_weight: float = 1.0


@dataclass(frozen=True)
class Plan:
    name: str = "base"
    fixed_modality: str = "UNKNOWN"
    moving_modality: str = "UNKNOWN"
    spacing_mm: float = 2.0
    fixed: Prep = Prep()
    moving: Prep = Prep()
    features: str | bool = "auto"
    targets: tuple[str, ...] = ()
    qc_labels: tuple[str, ...] = ()
    mask_dilate_mm: float = 8.0
    roi_crop: bool = False
    roi_margin_mm: float = 20.0
    init: tuple[str, ...] = ("geometry",)
    flip_check: bool = False
    rotations_deg: tuple[tuple[float, float, float], ...] = ((0.0, 0.0, 0.0),)
    stages: tuple[Stage, ...] = (Stage("rigid"), Stage("affine", n_resolutions=3))
    gates: Gates = field(default_factory=Gates)


_CT = Prep(percentiles=None)
_MR = Prep(percentiles=(0.5, 99.5))


def _window(name: str) -> Prep:
    return Prep(window=name, percentiles=None)


_BASE = Plan()
# The settings of each named plan.
PRESETS = {
    p.name: p
    for p in (
        _BASE,
        replace(_BASE, name="ct_cbct_igrt", fixed_modality="CT", moving_modality="CBCT", spacing_mm=1.5, fixed=_window("ct_bone"), moving=_window("ct_bone"), features=False, mask_dilate_mm=5.0, stages=(Stage("rigid", "ncc", 4, 500, 5000),), gates=Gates(min_ncc_gain=0.01, max_translation_mm=40.0, max_scale_deviation=0.02)),
        replace(_BASE, name="ct_ct_liver_followup", fixed_modality="CT", moving_modality="CT", spacing_mm=1.5, fixed=_window("ct_liver"), moving=_window("ct_liver"), features=False, targets=("liver",), qc_labels=("liver", "spleen", "kidney_right"), roi_crop=True, roi_margin_mm=25.0, init=("organ_centroid",), stages=(Stage("rigid", "ncc", 3, 400), Stage("affine", "ncc", 3, 400), Stage("bspline", "ncc", 3, 600, 8000, 20.0, 1.5)), gates=Gates(min_ncc_gain=0.02, max_folding_fraction=5e-4, min_dice={"liver": 0.92})),
        replace(_BASE, name="ct_ct_lung_4d", fixed_modality="CT", moving_modality="CT", spacing_mm=1.5, fixed=_window("ct_lung"), moving=_window("ct_lung"), features=False, targets=("lung_left", "lung_right"), qc_labels=("lung_left", "lung_right"), mask_dilate_mm=10.0, roi_crop=True, init=("organ_centroid",), stages=(Stage("rigid", "ncc", 3, 300), Stage("bspline", "ncc", 4, 1000, 10000, 15.0, 0.5)), gates=Gates(min_ncc_gain=0.02, min_dice={"lung_left": 0.95, "lung_right": 0.95})),
        replace(_BASE, name="ct_mr_abdomen", fixed_modality="CT", moving_modality="MR", fixed=_CT, moving=_MR, targets=("liver",), qc_labels=("liver", "spleen", "kidney_left", "kidney_right"), mask_dilate_mm=10.0, init=("geometry", "moments", "organ_centroid"), rotations_deg=((0.0, 0.0, 0.0), (0.0, 0.0, 10.0), (0.0, 0.0, -10.0)), stages=(Stage("rigid", "auto", 4, 768, 6000), Stage("affine", "auto", 3, 512, 6000), Stage("bspline", "auto", 3, 512, 8000)), gates=Gates(min_nmi_gain=0.0, min_dice={"liver": 0.85})),
        replace(_BASE, name="mr_ct_prostate", fixed_modality="CT", moving_modality="MR", spacing_mm=1.5, fixed=_window("ct_soft"), moving=_MR, targets=("prostate",), qc_labels=("prostate", "urinary_bladder", "rectum"), mask_dilate_mm=12.0, roi_crop=True, roi_margin_mm=30.0, init=("organ_centroid",), stages=(Stage("rigid", "auto", 4, 600), Stage("affine", "auto", 3, 400), Stage("bspline", "auto", 3, 600, 6000, 12.0, 3.0)), gates=Gates(min_nmi_gain=0.0, max_folding_fraction=2e-4, max_tre_mm=3.0, min_dice={"prostate": 0.80})),
        replace(_BASE, name="mr_mr_brain", fixed_modality="MR", moving_modality="MR", spacing_mm=1.5, fixed=_MR, moving=_MR, mask_dilate_mm=5.0, init=("geometry", "moments"), stages=(Stage("rigid", "auto", 4, 500),), gates=Gates(max_translation_mm=50.0, max_scale_deviation=0.02, max_folding_fraction=0.0)),
        replace(_BASE, name="pet_ct_wholebody", fixed_modality="CT", moving_modality="PT", spacing_mm=3.0, fixed=_window("ct_soft"), moving=Prep(percentiles=(0.0, 99.5)), mask_dilate_mm=10.0, init=("identity", "geometry", "moments"), stages=(Stage("rigid", "auto", 4, 400, 5000),), gates=Gates(min_nmi_gain=0.0, max_translation_mm=60.0, max_scale_deviation=0.05)),
    )
}


def preset(name: str, **overrides: Any) -> Plan:
    """A named plan with some settings replaced; unknown names are errors. None is a value like any other."""
    if name not in PRESETS:
        raise ValueError(f"unknown plan {name!r}; there are {sorted(PRESETS)}")
    known = {f.name for f in fields(Plan)}
    if wrong := overrides.keys() - known:
        raise ValueError(f"unknown settings: {sorted(wrong)}")
    return replace(PRESETS[name], **overrides)


def as_json(plan: Plan) -> str:
    """The whole plan as JSON with sorted keys; ``from_settings`` makes the plan of it again."""
    return json.dumps(asdict(plan), sort_keys=True)


def merged(base: dict[str, Any], updates: dict[str, Any]) -> dict[str, Any]:
    """base with updates: dictionaries are merged, everything else is replaced, None leaves what is there."""
    out = dict(base)
    for key, value in updates.items():
        if value is not None:
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def from_settings(values: dict[str, Any]) -> Plan:
    """A plan from nested dictionaries and lists, as ``dataclasses.asdict`` or a parsed file has them; unknown names are errors."""

    def made(kind: type, given: dict[str, Any]) -> Any:
        if wrong := given.keys() - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown settings of {kind.__name__}: {sorted(wrong)}")
        return kind(**{k: _tuples(v) for k, v in given.items()})

    parts = {"fixed": Prep, "moving": Prep, "gates": Gates}
    values = {k: made(parts[k], v) if k in parts and isinstance(v, dict) else v for k, v in values.items()}
    if "stages" in values:
        values["stages"] = tuple(made(Stage, s) if isinstance(s, dict) else s for s in values["stages"])
    return made(Plan, values)


def _tuples(v: Any) -> Any:
    return tuple(map(_tuples, v)) if isinstance(v, list | tuple) else v


def overridden(plan: Plan, assignments: list[str]) -> Plan:
    """The plan with ``dotted.path=value`` settings: numbers in a path are positions in a list, values are JSON, or text if they are not."""
    data = json.loads(json.dumps(asdict(plan)))
    for item in assignments:
        path, equals, raw = item.partition("=")
        if not equals:
            raise ValueError(f"not a setting of the form path=value: {item!r}")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        *above, last = path.strip().split(".")
        node = data
        try:
            for part in above:
                node = node[int(part)] if isinstance(node, list) else node[part]
            node[int(last) if isinstance(node, list) else last] = value
        except (KeyError, IndexError, TypeError, ValueError):
            raise ValueError(f"no such setting: {path!r}") from None
    return from_settings(data)


def metric_of(stage: Stage, plan: Plan, with_features: bool = False) -> str:
    """The metric of a stage: as it says, else features if there are any, correlation within one modality family, or mutual
    information."""
    from ..functions.names import FAMILIES

    same = FAMILIES.get(plan.fixed_modality.upper(), plan.fixed_modality) == FAMILIES.get(plan.moving_modality.upper(), plan.moving_modality)
    if stage.metric.startswith("features") and not with_features:
        return "ncc" if same else "mi"
    if stage.metric != "auto":
        return stage.metric
    return "features_ncc" if with_features else "ncc" if same else "mi"


def adapted(stage: Stage, deformable: bool, grid_mm: float) -> Stage:
    """A deformable stage for an organ: coarse and stiff on rigid organs, no coarser than the organ's grid on others."""
    if stage.kind != "bspline":
        return stage
    return replace(stage, grid_mm=min(stage.grid_mm, grid_mm)) if deformable else replace(stage, grid_mm=max(stage.grid_mm, 40.0), bending_weight=max(stage.bending_weight, 5.0))
