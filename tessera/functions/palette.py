"""Colours as NumPy arrays: CIELAB, hard and soft names, and the probability table they read.

Kernels take the distinct colours of a batch, so the cascade runs once a colour
and not once a pixel.
"""

from __future__ import annotations

import numpy as np

from .colour import CATEGORIES, DELTA, RGB_TO_XYZ, TERMS, WHITE

MATRIX, LEVELS = np.array(RGB_TO_XYZ), 32
CODE = {c: i for i, c in enumerate(CATEGORIES)}


def lab(rgb: np.ndarray) -> np.ndarray:
    """L, a, b of channels 0..255, one row a colour."""
    rgb = np.asarray(rgb)
    whole = rgb.dtype.kind in "iu"  # 256 levels: each is computed once
    u = (np.arange(256.0) if whole else rgb.astype(np.float64)) / 255.0
    linear = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    linear = linear[rgb] if whole else linear
    t = linear @ MATRIX.T / np.array(WHITE)
    f = np.where(t > DELTA**3, np.cbrt(t), t / (3 * DELTA**2) + 4 / 29)
    return np.column_stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])])


def rgb(colours: np.ndarray) -> np.ndarray:
    """Channels 0..1, clipped, of L, a, b rows."""
    y = (colours[:, 0] + 16) / 116
    f = np.column_stack([y + colours[:, 1] / 500, y, y - colours[:, 2] / 200])
    t = np.where(f > DELTA, f**3, 3 * DELTA**2 * (f - 4 / 29)) * np.array(WHITE)
    linear = t @ np.linalg.inv(MATRIX).T
    return np.clip(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.maximum(linear, 0.0) ** (1 / 2.4) - 0.055), 0.0, 1.0)


def chroma_hue(colours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = colours[:, 1], colours[:, 2]
    return np.sqrt(a * a + b * b), np.degrees(np.arctan2(b, a)) % 360.0


def checked_table(weights: np.ndarray) -> np.ndarray:
    """The probabilities of the terms for each of 32**3 cells of colour, from a table of weights."""
    table = np.asarray(weights, dtype=np.float64)
    if table.shape != (LEVELS**3, len(TERMS)):
        raise ValueError(f"the table has shape {table.shape}, not {(LEVELS**3, len(TERMS))}")
    if not np.isfinite(table).all() or (table < 0).any():
        raise ValueError("the table holds negative or non-finite weights")
    total = table.sum(axis=1, keepdims=True)
    if (total <= 0).any():
        raise ValueError("a row of the table has no weight")
    return table / total


def synthetic_table() -> np.ndarray:
    """A stand-in for the measured table, by a rule."""
    index, term = np.arange(LEVELS**3)[:, None], np.arange(len(TERMS))[None, :]
    return checked_table(1 + (index * (2 * term + 3) + term * 977) % 97)


def cells(colours: np.ndarray) -> np.ndarray:
    """Row of the table of each colour (channels 0..255)."""
    r, g, b = (np.asarray(colours).astype(np.int64) // 8).T
    return r + LEVELS * g + LEVELS**2 * b


def hard_names(colours: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, category by the term alone, and final category (numbers in TERMS, CATEGORIES) of Lab rows with probabilities p.

    Each step sees the category that the steps before it left.
    """
    light = colours[:, 0]
    chroma, hue = chroma_hue(colours)
    of = {t: p[:, i] for i, t in enumerate(TERMS)}
    term = p.argmax(axis=1)
    is_term = lambda *names: np.isin(term, [TERMS.index(n) for n in names])
    # Every threshold of the cascade.
    pale = light >= 42
    base = np.select(
        [is_term("orange"), is_term("brown") & pale, is_term("brown"), is_term("gray") & pale, is_term("gray"), is_term("pink") & ((hue <= 45) | (hue >= 330)), is_term("pink") & pale, is_term("pink")],
        [CODE["rufous"], CODE["light_brown"], CODE["dark_brown"], CODE["light_gray"], CODE["dark_gray"], CODE["red"], CODE["light_brown"], CODE["dark_brown"]],
        default=np.array([CODE.get(t, 0) for t in TERMS])[term],
    )
    label = base.copy()
    bluish = is_term("green", "gray") & (chroma >= 5) & (hue >= 170) & (hue < 315)
    reddish = is_term("brown", "orange") & (((hue >= 41) & (hue < 70) & (chroma >= 22) & ~((light < 30) & (chroma < 35)) & ~((light >= 45) & (chroma < 45))) | ((hue >= 70) & (hue < 82) & (chroma >= 22) & (chroma < 30) & (light < 45)))
    crimson = is_term("brown", "orange", "pink") & ((((hue < 41) | (hue >= 350)) & (chroma >= 12)) | ((hue >= 41) & (hue < 47) & (chroma >= 30)))
    golden = is_term("brown", "orange", "green") & (hue >= 70) & (hue < 100) & (chroma >= 30)
    for mask, name in ((bluish, "blue"), (reddish, "rufous"), (crimson, "red"), (golden, "yellow")):  # later ones win
        label[mask] = CODE[name]
    browns, grays = ("light_brown", "dark_brown"), ("light_gray", "dark_gray")

    def step(mask, donors, name):
        label[mask & np.isin(label, [CODE[d] for d in donors])] = CODE[name]

    ratio = of["green"] / np.maximum.reduce([of["brown"], of["orange"], of["yellow"], np.full(len(p), 1e-12)])
    olive = (light <= 34) & (hue >= 72) & (hue < 85) & (chroma <= 26) & is_term("brown")
    step((light >= 45) & (chroma <= 30), ["rufous"], "light_brown")
    step((of["green"] >= 0.08) & (chroma >= 10) & (hue >= 65) & (hue < 145) & (ratio >= 0.25) & ((hue >= 85) | olive) & ~((hue < 80) & (chroma >= 35)), ["yellow", "rufous", *browns, *grays], "green")
    step((light >= 85) & (chroma <= 25), ["yellow"], "white")
    step((light >= 58) & (chroma <= np.minimum(24, 14 + 0.35 * (light - 50))), ["light_brown"], "white")
    dull = (chroma <= 12) & (hue >= 60) & np.isin(label, [CODE[b] for b in browns])
    label[dull] = np.where(pale, CODE["light_gray"], CODE["dark_gray"])[dull]
    step(pale & (chroma <= 20) & (hue >= 72) & (of["gray"] / np.maximum(of["brown"], 1e-12) >= 0.3), browns, "light_gray")
    step(light >= 25, ["black"], "dark_gray")
    step((of["blue"] >= 0.06) & (chroma >= 5) & (hue >= 230) & (hue < 330), ["black", "dark_gray"], "blue")
    step((light <= 22) & (chroma <= 20) & (of["purple"] / np.maximum(of["red"], 1e-12) >= 0.6), ["red"], "purple")
    step(light <= 22, [*browns, *grays], "black")
    return term, base, label


def _rise(x, at, width=4.0):
    return 1.0 / (1.0 + np.exp(-np.clip((x - at) / width, -700, 700)))


def soft_names(colours: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Memberships of CATEGORIES, one row a colour; every transfer moves mass, so they sum to 1."""
    light = colours[:, 0]
    chroma, hue = chroma_hue(colours)
    of = {t: p[:, i] for i, t in enumerate(TERMS)}
    fall = lambda x, at, width=4.0: _rise(-x, -at, width)
    gate = lambda x, lo, hi: _rise(x, lo) * fall(x, hi)
    # Centres, widths and ceilings of all gates.
    pale = _rise(light, 42)
    pink = np.where(hue < 180, fall(hue, 45), _rise(hue, 330))
    brown = of["brown"] + of["pink"] * (1 - pink)
    m = {c: of[c].copy() for c in ("black", "blue", "green", "purple", "white", "yellow")}
    m |= {"rufous": of["orange"].copy(), "red": of["red"] + of["pink"] * pink, "light_gray": of["gray"] * pale, "dark_gray": of["gray"] * (1 - pale), "light_brown": brown * pale, "dark_brown": brown * (1 - pale)}
    browns, grays = ["light_brown", "dark_brown"], ["light_gray", "dark_gray"]

    def move(donors, *shares):
        """Give each (receiver, share) its share of what the donors have."""
        given = sum(m[d] for d in donors)
        for d in donors:
            m[d] = m[d] * (1 - sum(s for _, s in shares))
        for name, share in shares:
            m[name] = m[name] + given * share

    ratio = of["green"] / np.maximum.reduce([of["brown"], of["orange"], of["yellow"], np.full(len(p), 1e-12)])
    olive = np.where(hue < 85, fall(chroma, 26) * (p.argmax(axis=1) == TERMS.index("brown")), 1.0)
    leafy = _rise(ratio, 0.25, 0.04) * np.maximum(_rise(hue, 85), _rise(hue, 72) * fall(hue, 85) * fall(light, 34))
    dull = fall(chroma, 12) * _rise(hue, 60) * 0.95
    move(["green", *grays], ("blue", gate(hue, 170, 315) * _rise(chroma, 5) * 0.85))
    move(browns, ("rufous", gate(hue, 41, 82) * _rise(chroma, 22) * _rise(light, 25) * fall(light, 45) * 0.9))
    move(["rufous"], ("light_brown", _rise(light, 45) * fall(chroma, 30) * 0.9))
    move(["rufous", *browns], ("red", np.where(hue < 180, fall(hue, 41), _rise(hue, 350)) * _rise(chroma, 12) * 0.85))
    move(["rufous", *browns, "green"], ("yellow", gate(hue, 70, 100) * _rise(chroma, 30) * 0.85))
    move(["yellow", "rufous", *browns, *grays], ("green", gate(hue, 65, 145) * _rise(chroma, 10) * olive * _rise(of["green"], 0.08, 0.02) * leafy * (1 - fall(hue, 80) * _rise(chroma, 35)) * 0.9))
    move(["yellow"], ("white", _rise(light, 85) * fall(chroma, 25) * 0.95))
    move(["light_brown"], ("white", _rise(light, 58) * _rise(np.minimum(24, 14 + 0.35 * (light - 50)) - chroma, 0) * 0.95))
    move(browns, ("light_gray", dull * pale), ("dark_gray", dull * (1 - pale)))
    move(browns, ("light_gray", _rise(light, 42) * fall(chroma, 20) * _rise(hue, 72) * _rise(of["gray"] / np.maximum(of["brown"], 1e-12), 0.3, 0.08) * 0.95))
    move(["black"], ("dark_gray", _rise(light, 25) * 0.95))
    move(["black", "dark_gray"], ("blue", gate(hue, 230, 330) * _rise(chroma, 5) * _rise(of["blue"], 0.06, 0.02) * 0.9))
    move(["red"], ("purple", fall(light, 22) * fall(chroma, 20) * _rise(of["purple"] / np.maximum(of["red"], 1e-12), 0.6, 0.1) * 0.9))
    move([*browns, *grays], ("black", fall(light, 22) * 0.95))
    return np.column_stack([m[c] for c in CATEGORIES])
