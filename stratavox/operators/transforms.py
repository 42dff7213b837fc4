"""Linear spatial transforms as 4 by 4 matrices, always from fixed to moving space."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np


def translation(offset: Sequence[float]) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = offset
    return m


def about(linear: np.ndarray, centre: Sequence[float], offset: Sequence[float] = (0, 0, 0)) -> np.ndarray:
    """x -> linear (x - centre) + centre + offset."""
    m = np.eye(4)
    m[:3, :3] = linear
    m[:3, 3] = np.array(centre) - linear @ np.array(centre) + np.array(offset)
    return m


def rotation(degrees: Sequence[float]) -> np.ndarray:
    """Rotations about x, then y, then z: Rz Ry Rx."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(a), math.sin(a)) for a in np.radians(degrees))
    rx = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    ry = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    rz = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return rz @ ry @ rx


def from_parameters(kind: str, p: Sequence[float], centre: Sequence[float] = (0, 0, 0)) -> np.ndarray:
    """translation (3), rigid (3 angles in radians, 3 mm), similarity (the same and a scale), affine (9 and 3), about a centre."""
    if kind == "translation":
        return translation(p)
    if kind in ("rigid", "similarity"):
        r = rotation(np.degrees(p[:3]))
        return about(r * (p[6] if kind == "similarity" else 1.0), centre, p[3:6])
    if kind == "affine":
        return about(np.array(p[:9], float).reshape(3, 3), centre, p[9:12])
    raise ValueError(f"unknown kind of transform {kind!r}")


def composed(transforms: Sequence[np.ndarray]) -> np.ndarray:
    """One matrix for transforms applied in the order of the list."""
    m = np.eye(4)
    for t in transforms:
        m = t @ m
    return m


def linearised(move: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-3) -> np.ndarray:
    """The matrix of a point function that is linear; an error if it is not, by more than the tolerance in mm."""
    base = move(np.zeros((1, 3)))[0]
    m = np.eye(4)
    m[:3, 3] = base
    m[:3, :3] = (move(np.eye(3) * 100.0) - base).T / 100.0
    probe = np.array([[37.0, -59.0, 83.0], [-71.0, 13.0, -29.0]])
    if np.abs(move(probe) - (probe @ m[:3, :3].T + base)).max() > tolerance:
        raise ValueError("the transform is not linear")
    return m


def inverted(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m)


def is_identity(m: np.ndarray, tolerance: float = 1e-6) -> bool:
    probe = np.array([[0, 0, 0, 1.0], [100, 0, 50, 1], [-30, 70, 10, 1]])
    return bool(np.abs(probe @ m.T - probe).max() < tolerance)


def decomposed(m: np.ndarray) -> dict[str, object]:
    """Translation at the world's origin, Euler angles (z, y, x order), scales, shears and determinant of a matrix."""
    q, r = np.linalg.qr(m[:3, :3])
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    q, r = q * sign, (r.T * sign).T
    if np.linalg.det(q) < 0:
        q[:, 2], r[2] = -q[:, 2], -r[2]
    ry = math.asin(float(np.clip(-q[2, 0], -1, 1)))
    rx, rz = math.atan2(q[2, 1], q[2, 2]), math.atan2(q[1, 0], q[0, 0])
    scale = np.diag(r)
    return {
        "translation_mm": m[:3, 3].tolist(),
        "rotation_deg": np.degrees([rx, ry, rz]).tolist(),
        "scale": scale.tolist(),
        "shear": [float(r[0, 1] / scale[0]), float(r[0, 2] / scale[0]), float(r[1, 2] / scale[1])],
        "determinant": float(np.linalg.det(m[:3, :3])),
    }


def kind_of(m: np.ndarray) -> str:
    """RIGID or AFFINE, by the determinant."""
    return "RIGID" if abs(np.linalg.det(m[:3, :3]) - 1) < 1e-3 else "AFFINE"


def as_text(m: np.ndarray) -> str:
    return "\n".join(" ".join(f"{v:.10f}" for v in row) for row in m) + "\n"


def parse_transform(text: str) -> np.ndarray:
    """The matrix of a text transform file: lines ``Transform``, ``Parameters`` and ``FixedParameters``; several are composed."""
    out, kind, p = [], "", []
    for line in text.splitlines():
        name, _, rest = line.partition(":")
        if name == "Transform":
            kind = rest.strip().split("_")[0]
        elif name == "Parameters":
            p = [float(v) for v in rest.split()]
        elif name == "FixedParameters":
            centre = ([float(v) for v in rest.split()] + [0.0] * 3)[:3]
            kinds = {"TranslationTransform": "translation", "Euler3DTransform": "rigid", "AffineTransform": "affine", "MatrixOffsetTransformBase": "affine"}
            if kind not in kinds:
                raise ValueError(f"unknown transform {kind!r}")
            out.append(from_parameters(kinds[kind], p, centre))
    if not out:
        raise ValueError("no transform in this text")
    return composed(out[::-1])
