"""Tone mapping, colour matrices and transfer functions as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.numeric import clamp01, non_negative, over

# Matrices of the colour spaces to and from CIE XYZ, rows in order R, G, B.
TO_XYZ = {
    "srgb": ((0.4123907993, 0.3575843394, 0.1804807884), (0.2126390059, 0.7151686788, 0.0721923154), (0.0193308187, 0.1191947798, 0.9505321522)),
    "rec2020": ((0.6369580483, 0.1446169036, 0.1688809752), (0.2627002120, 0.6779980715, 0.0593017165), (0.0, 0.0280726930, 1.0609850577)),
    "aces_ap0": ((0.9525523959, 0.0, 0.0000936786), (0.3439664498, 0.7281660966, -0.0721325464), (0.0, 0.0, 1.0088251844)),
    "aces_ap1": ((0.6624541811, 0.1340042065, 0.1561876870), (0.2722287168, 0.6740817658, 0.0536895174), (-0.0055746495, 0.0040607335, 1.0103391003)),
    "xyz": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
}
FROM_XYZ = {
    "srgb": ((3.2409699419, -1.5373831776, -0.4986107603), (-0.9692436363, 1.8759675015, 0.0415550574), (0.0556300797, -0.2039769589, 1.0569715142)),
    "rec2020": ((1.7166511880, -0.3556707838, -0.2533662814), (-0.6666843518, 1.6164812366, 0.0157685458), (0.0176398574, -0.0427706133, 0.9421031212)),
    "aces_ap0": ((1.0498110175, 0.0, -0.0000974845), (-0.4959030231, 1.3733130458, 0.0982400361), (0.0, 0.0, 0.9912520182)),
    "aces_ap1": ((1.6410233797, -0.3248032942, -0.2364246952), (-0.6636628587, 1.6153315917, 0.0167563477), (0.0117218943, -0.0082844420, 0.9883948585)),
    "xyz": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
}
WHITE = {"srgb": "d65", "rec2020": "d65", "aces_ap0": "d60", "aces_ap1": "d60", "xyz": "d65"}
WHITE_XYZ = {"d65": (0.95047, 1.0, 1.08883), "d60": (0.952646, 1.0, 1.008825)}
# The Bradford cone matrix and its inverse.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_INVERSE = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))

# Constants of the PQ and HLG curves.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073

DEFAULT_LUMINANCE = (0.2126, 0.7152, 0.0722)


def color_matrix(source: str, target: str) -> np.ndarray:
    """The 3x3 matrix from ``source`` to ``target``, with Bradford adaptation between white points."""
    if source == target:
        return np.eye(3)
    middle = np.eye(3)
    if WHITE[source] != WHITE[target]:
        cone = np.array(BRADFORD)
        a, b = (cone @ np.array(WHITE_XYZ[WHITE[s]]) for s in (source, target))
        ratio = np.divide(b, a, out=np.ones(3), where=a != 0)
        middle = np.array(BRADFORD_INVERSE) @ np.diag(ratio) @ cone
    return np.array(FROM_XYZ[target]) @ middle @ np.array(TO_XYZ[source])


def apply_matrix(m: np.ndarray, channels: list[Column]) -> list[Column]:
    """The first three channels multiplied by ``m``; others, and fewer than three, as they are."""
    if len(channels) < 3 or np.array_equal(m, np.eye(3)):
        return list(channels)
    r, g, b = channels[:3]
    return [r * float(row[0]) + g * float(row[1]) + b * float(row[2]) for row in m] + list(channels[3:])


def luminance_weights(red: tuple, green: tuple, blue: tuple, white: tuple) -> tuple[float, float, float]:
    """Luminance weights of primaries given as (x, y); the default where they are degenerate.

    The primaries are scaled so that together they make the white point.
    """
    if white[1] == 0:
        return DEFAULT_LUMINANCE
    primaries = np.array([(x, y, 1 - x - y) for x, y in (red, green, blue)]).T
    if abs(np.linalg.det(primaries)) < 1e-12:
        return DEFAULT_LUMINANCE
    x, y = white
    scale = np.linalg.solve(primaries, np.array([x / y, 1.0, (1 - x - y) / y]))
    weights = scale * primaries[1]
    return tuple((weights / weights.sum()).tolist())


@dataclass(frozen=True)
class ToneMap:
    """Parameters; zero exposure or white mean 1, all-zero Hable constants the usual ones."""

    exposure: float = 0.0
    white: float = 0.0
    a: float = 0.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 0.0
    f: float = 0.0
    w: float = 0.0

    def resolved(self) -> ToneMap:
        hable = (self.a, self.b, self.c, self.d, self.e, self.f, self.w)
        if not any(hable):
            hable = (0.15, 0.5, 0.1, 0.2, 0.02, 0.3, 11.2)
        return ToneMap(self.exposure or 1.0, self.white or 1.0, *hable)


def reinhard(v: Column, p: ToneMap = ToneMap()) -> Column:
    v = v * p.resolved().exposure
    return over(v, v + 1)


def reinhard_extended(v: Column, p: ToneMap = ToneMap()) -> Column:
    p = p.resolved()
    v = v * p.exposure
    return over(v * (v / (p.white * p.white) + 1), v + 1)


def aces(v: Column, p: ToneMap = ToneMap()) -> Column:
    v = v * p.resolved().exposure
    return clamp01(over(v * (v * 2.51 + 0.03), v * (v * 2.43 + 0.59) + 0.14))


def _hable_curve(v, p: ToneMap):
    return (v * (v * p.a + p.c * p.b) + p.d * p.e) / (v * (v * p.a + p.b) + p.d * p.f) - p.e / p.f


def hable(v: Column, p: ToneMap = ToneMap()) -> Column:
    p = p.resolved()
    top = _hable_curve(p.w, p)
    return _hable_curve(v * p.exposure, p) / (top if top else 1.0)


TONE_MAPS = {"reinhard": reinhard, "reinhard_ext": reinhard_extended, "aces": aces, "hable": hable}


def tone_map(channels: list[Column], operator: str, p: ToneMap = ToneMap()) -> list[Column]:
    """The first three channels tone-mapped; alpha passes."""
    f = TONE_MAPS[operator]
    return [f(c, p) for c in channels[:3]] + list(channels[3:])


def encode(v: Column, curve: str) -> Column:
    """Linear light to a transfer curve; negatives and NaN count as 0."""
    if curve == "linear":
        return v
    v = non_negative(v)
    match curve:
        case "srgb":
            return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
        case "gamma22":
            return F.pow(v, F.lit(1 / 2.2))
        case "gamma24":
            return F.pow(v, F.lit(1 / 2.4))
        case "rec709":
            return F.when(v < 0.018, v * 4.5).otherwise(F.pow(v, F.lit(0.45)) * 1.099 - 0.099)
        case "pq":
            p = F.pow(v, F.lit(PQ_M1))
            return F.pow((p * PQ_C2 + PQ_C1) / (p * PQ_C3 + 1), F.lit(PQ_M2))
        case "hlg":
            return F.when(v <= 1 / 12, F.sqrt(v * 3)).otherwise(F.ln(F.greatest(v * 12 - HLG_B, F.lit(1e-30))) * HLG_A + HLG_C)
    raise ValueError(f"unknown curve {curve}")


def decode(v: Column, curve: str) -> Column:
    """A transfer curve back to linear light; sRGB, Rec. 709 and HLG keep negatives."""
    match curve:
        case "linear":
            return v
        case "srgb":
            return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
        case "gamma22":
            return F.pow(non_negative(v), F.lit(2.2))
        case "gamma24":
            return F.pow(non_negative(v), F.lit(2.4))
        case "rec709":
            return F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, F.lit(1 / 0.45)))
        case "pq":
            p = F.pow(non_negative(v), F.lit(1 / PQ_M2))
            return F.pow(over(non_negative(p - PQ_C1), -(p * PQ_C3) + PQ_C2), F.lit(1 / PQ_M1))
        case "hlg":
            return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12)
    raise ValueError(f"unknown curve {curve}")


CURVES = ("srgb", "gamma22", "gamma24", "rec709", "pq", "hlg")


def to_rgba_luma_chroma(y: Column, ry: Column, by: Column, weights: tuple[float, float, float] = DEFAULT_LUMINANCE) -> list[Column]:
    """Red, green and blue of luminance and chroma differences."""
    wr, wg, wb = weights
    if wg == 0:
        raise ValueError("the green luminance weight is 0")
    r, b = (ry + 1) * y, (by + 1) * y
    return [r, (y - r * wr - b * wb) / wg, b]
