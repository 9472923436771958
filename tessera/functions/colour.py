"""sRGB, CIELAB and colour naming as SQL expression text.

The text is what another engine is asked to check the operators with; Spark's
own form is in `palette` and `operators.colour`.
Doubles are written with an exponent: plain decimals would be DECIMAL.
"""

from __future__ import annotations

import numpy as np

# sRGB to XYZ, D65 white, and the knees of the transfer curves.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
XYZ_TO_RGB = tuple(tuple(float(v) for v in row) for row in np.linalg.inv(np.array(RGB_TO_XYZ)))
DELTA = 6.0 / 29.0


def num(x: float) -> str:
    return f"{float(x):.17e}"


def linear(c: str) -> str:
    """Linear light of a channel 0..255."""
    u = f"({c} / {num(255)})"
    return f"(CASE WHEN {u} <= {num(0.04045)} THEN {u} / {num(12.92)} ELSE pow(({u} + {num(0.055)}) / {num(1.055)}, {num(2.4)}) END)"


def gamma(c: str) -> str:
    """Channel 0..1, clipped, of linear light."""
    raw = f"CASE WHEN {c} <= {num(0.0031308)} THEN {num(12.92)} * {c} ELSE {num(1.055)} * pow(greatest({c}, {num(0)}), {num(1 / 2.4)}) - {num(0.055)} END"
    return f"greatest(least({raw}, {num(1)}), {num(0)})"


def lab_f(t: str) -> str:
    return f"(CASE WHEN {t} > {num(DELTA**3)} THEN cbrt({t}) ELSE {t} / {num(3 * DELTA**2)} + {num(4 / 29)} END)"


def lab_f_inverse(t: str) -> str:
    return f"(CASE WHEN {t} > {num(DELTA)} THEN {t} * {t} * {t} ELSE {num(3 * DELTA**2)} * ({t} - {num(4 / 29)}) END)"


def to_lab(source: str, keep: str = "stem, pix, r, g, b") -> str:
    """Query: the columns `keep` of source (which has r, g, b) with L, a, b_ (CIELAB)."""
    lin = f"SELECT {keep}, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM ({source}) s0"
    mixed = ", ".join(f"({num(row[0])} * lr + {num(row[1])} * lg + {num(row[2])} * lb) / {num(w)} AS {n}" for row, w, n in zip(RGB_TO_XYZ, WHITE, "xyz", strict=True))
    xyz = f"SELECT {keep}, {mixed} FROM ({lin}) s1"
    f = f"SELECT {keep}, {lab_f('x')} AS fx, {lab_f('y')} AS fy, {lab_f('z')} AS fz FROM ({xyz}) s2"
    return f"SELECT {keep}, {num(116)} * fy - {num(16)} AS L, {num(500)} * (fx - fy) AS a, {num(200)} * (fy - fz) AS b_ FROM ({f}) s3"


def to_rgb(source: str, keep: str, lab: tuple[str, str, str] = ("L", "a", "b_")) -> str:
    """Query: `keep` with r1, g1, b1 (0..1, clipped) of the CIELAB columns of source."""
    f = f"SELECT {keep}, ({lab[0]} + {num(16)}) / {num(116)} AS fy, ({lab[0]} + {num(16)}) / {num(116)} + {lab[1]} / {num(500)} AS fx, ({lab[0]} + {num(16)}) / {num(116)} - {lab[2]} / {num(200)} AS fz FROM ({source}) t0"
    xyz = f"SELECT {keep}, " + ", ".join(f"{lab_f_inverse('f' + n)} * {num(w)} AS {n}" for n, w in zip("xyz", WHITE, strict=True)) + f" FROM ({f}) t1"
    lin = f"SELECT {keep}, " + ", ".join(f"{num(row[0])} * x + {num(row[1])} * y + {num(row[2])} * z AS l{n}" for row, n in zip(XYZ_TO_RGB, "rgb", strict=True)) + f" FROM ({xyz}) t2"
    return f"SELECT {keep}, " + ", ".join(f"{gamma('l' + n)} AS {n}1" for n in "rgb") + f" FROM ({lin}) t3"


def truncated(c: str) -> str:
    """uint8 by truncation (as the gray and chroma operators store pixels); what rounding errors made of a whole level stays that level."""
    return f"CAST(floor(round({c} * {num(255)}, 6)) AS INT)"


CHROMA = "sqrt(a * a + b_ * b_)"
HUE = f"(CASE WHEN b_ < 0 THEN degrees(atan2(b_, a)) + {num(360)} ELSE degrees(atan2(b_, a)) END)"

# The eleven basic colour terms, the twelve plumage categories, and the chromatic ones among them.
TERMS = "black blue brown gray green orange pink purple red white yellow".split()
CATEGORIES = "black white light_gray dark_gray blue purple red yellow green rufous light_brown dark_brown".split()
CHROMATIC = "blue purple red yellow green rufous light_brown dark_brown".split()


def table_probability(term: int, index: str) -> str:
    """Unnormalised weight of a term in the synthetic stand-in of the 32768-row probability table."""
    return f"(1 + ({index} * (2 * {term} + 3) + {term} * 977) % 97)"


TABLE_INDEX = "(CAST(floor(r / 8) AS INT) + 32 * CAST(floor(g / 8) AS INT) + 1024 * CAST(floor(b / 8) AS INT))"


def named(lab: str, keep: str) -> str:
    """Query: keep, L, a, b_, C, h, raw, base and label of every pixel of `lab` (keep, L, a, b_, p_<term>).

    The cascade goes in a fixed order; each step sees the label the steps
    before it left.  What a step asks of the pixel itself is decided first, in
    one projection, so the steps pass narrow rows and stay in generated code.
    """
    d = num
    browns, grays = "'light_brown', 'dark_brown'", "'light_gray', 'dark_gray'"
    red = "(raw IN ('brown', 'orange', 'pink') AND (((h < 41 OR h >= 350) AND C >= 12) OR (h >= 41 AND h < 47 AND C >= 30)))"
    yellow = "(raw IN ('brown', 'orange', 'green') AND h >= 70 AND h < 100 AND C >= 30)"
    rufous = (
        "(raw IN ('brown', 'orange') AND ((h >= 41 AND h < 70 AND C >= 22 AND NOT (L < 30 AND C < 35) AND NOT (L >= 45 AND C < 45))"
        " OR (h >= 70 AND h < 82 AND C >= 22 AND C < 30 AND L < 45)))"
    )
    # Every threshold of the cascade.
    # Pixel condition, labels it applies to, label it gives (a condition alone for the steps that ask the raw term).
    steps = [
        ("L >= 45 AND C <= 30", "'rufous'", "'light_brown'"),
        (
            f"p_green >= {d(0.08)} AND C >= 10 AND h >= 65 AND h < 145 AND q >= {d(0.25)} AND (h >= 85 OR (L <= 34 AND h >= 72 AND h < 85 AND C <= 26 AND raw = 'brown')) AND NOT (h < 80 AND C >= 35)",
            f"'yellow', 'rufous', {browns}, {grays}", "'green'",
        ),
        ("L >= 85 AND C <= 25", "'yellow'", "'white'"),
        (f"L >= 58 AND C <= least({d(24)}, {d(14)} + {d(0.35)} * (L - 50))", "'light_brown'", "'white'"),
        ("C <= 12 AND h >= 60", browns, "CASE WHEN L >= 42 THEN 'light_gray' ELSE 'dark_gray' END"),
        (f"L >= 42 AND C <= 20 AND h >= 72 AND p_gray / greatest(p_brown, {d(1e-12)}) >= {d(0.3)}", browns, "'light_gray'"),
        ("L >= 25", "'black'", "'dark_gray'"),
        (f"p_blue >= {d(0.06)} AND C >= 5 AND h >= 230 AND h < 330", "'black', 'dark_gray'", "'blue'"),
        (f"L <= 22 AND C <= 20 AND p_purple / greatest(p_red, {d(1e-12)}) >= {d(0.6)}", "'red'", "'purple'"),
        ("L <= 22", f"{browns}, {grays}", "'black'"),
    ]
    p = ", ".join(f"p_{t}" for t in TERMS)
    top = f"SELECT {keep}, L, a, b_, {CHROMA} AS C, {HUE} AS h, {p}, p_green / greatest(p_brown, p_orange, p_yellow, {d(1e-12)}) AS q, greatest({p}) AS top FROM ({lab}) n0"
    raw = "CASE " + " ".join(f"WHEN p_{t} = top THEN '{t}'" for t in TERMS) + " END"
    terms = f"SELECT {keep}, L, a, b_, C, h, q, p_green, p_gray, p_brown, p_blue, p_purple, p_red, {raw} AS raw FROM ({top}) n1"
    base = (
        "CASE WHEN raw = 'orange' THEN 'rufous' WHEN raw IN ('brown', 'gray') AND L >= 42 THEN concat('light_', raw) WHEN raw IN ('brown', 'gray') THEN concat('dark_', raw)"
        " WHEN raw = 'pink' AND (h <= 45 OR h >= 330) THEN 'red' WHEN raw = 'pink' AND L >= 42 THEN 'light_brown' WHEN raw = 'pink' THEN 'dark_brown' ELSE raw END"
    )
    asked = ", ".join(f"({when}) AS k{i}" for i, (when, _, _) in enumerate(steps))
    first = f"CASE WHEN {yellow} THEN 'yellow' WHEN {red} THEN 'red' WHEN {rufous} THEN 'rufous' WHEN raw IN ('green', 'gray') AND C >= 5 AND h >= 170 AND h < 315 THEN 'blue' END"
    held = f"{keep}, L, a, b_, C, h, raw, base"
    left = lambda i: "".join(f", k{j}" for j in range(i, len(steps)))
    sql = f"SELECT {keep}, L, a, b_, C, h, raw, {base} AS base, {first} AS moved, {asked} FROM ({terms}) n2"
    sql = f"SELECT {held}, coalesce(moved, base) AS label{left(0)} FROM ({sql}) n3"
    for i, (_, donors, to) in enumerate(steps):
        sql = f"SELECT {held}, CASE WHEN k{i} AND label IN ({donors}) THEN {to} ELSE label END AS label{left(i + 1)} FROM ({sql}) c{i}"
    return sql


def with_probabilities(pixels: str, keep: str = "stem, pix, r, g, b") -> str:
    """Query: pixels with index into the probability table and p_<term>, which sum to 1."""
    weights = ", ".join(f"{table_probability(i, 'idx')} AS w_{t}" for i, t in enumerate(TERMS))
    total = " + ".join(f"w_{t}" for t in TERMS)
    return f"SELECT {keep}, idx, " + ", ".join(f"w_{t} / CAST({total} AS DOUBLE) AS p_{t}" for t in TERMS) + f" FROM (SELECT {keep}, idx, {weights} FROM (SELECT {keep}, {TABLE_INDEX} AS idx FROM ({pixels}) i0) i1) i2"


def sigmoid(x: str) -> str:
    return f"({num(1)} / ({num(1)} + exp(-greatest(least({x}, {num(700)}), {num(-700)}))))"


def window_gate(x: str, lo: float, hi: float, width: float) -> str:
    return f"({sigmoid(f'({x} - {num(lo)}) / {num(width)}')} * {sigmoid(f'({num(hi)} - {x}) / {num(width)}')})"


def soft_named(lab: str, keep: str) -> str:
    """Query: L and membership m_<category> of the twelve categories; each transfer moves mass, so they sum to 1."""
    s, d, w = sigmoid, num, 4.0
    up = lambda x, at, width=w: s(f"({x} - {d(at)}) / {d(width)}")
    down = lambda x, at, width=w: s(f"({d(at)} - {x}) / {d(width)}")
    light = up("L", 42)
    pink = f"(CASE WHEN h < 180 THEN {down('h', 45)} ELSE {up('h', 330)} END)"
    raw = "CASE " + " ".join(f"WHEN p_{t} = greatest({', '.join('p_' + x for x in TERMS)}) THEN '{t}'" for t in TERMS) + " END"
    tiny = d(1e-12)
    q = f"(p_green / greatest(p_brown, p_orange, p_yellow, {tiny}))"
    base = {c: f"p_{c}" for c in ("black", "blue", "green", "purple", "white", "yellow")}
    base |= {
        "rufous": "p_orange",
        "red": f"p_red + p_pink * {pink}",
        "light_gray": f"p_gray * {light}",
        "dark_gray": f"p_gray * ({d(1)} - {light})",
        "light_brown": f"(p_brown + p_pink * ({d(1)} - {pink})) * {light}",
        "dark_brown": f"(p_brown + p_pink * ({d(1)} - {pink})) * ({d(1)} - {light})",
    }
    browns, grays = ["light_brown", "dark_brown"], ["light_gray", "dark_gray"]
    red_hue = f"greatest(CASE WHEN h < 180 THEN {down('h', 41)} ELSE {d(0)} END, CASE WHEN h >= 180 THEN {up('h', 350)} ELSE {d(0)} END)"
    green_ratio = f"greatest({up(q, 0.25, 0.04)} * {up('h', 85)}, {up(q, 0.25, 0.04)} * {up('h', 72)} * {down('h', 85)} * {down('L', 34)})"
    dark_green = f"(CASE WHEN h < 85 THEN {down('C', 26)} * (CASE WHEN raw = 'brown' THEN 1 ELSE 0 END) ELSE {d(1)} END)"
    cream = s(f"(least({d(24)}, {d(14)} + {d(0.35)} * (L - 50)) - C) / {d(w)}")
    transfers = [
        (["green", *grays], "blue", f"{window_gate('h', 170, 315, w)} * {up('C', 5)} * {d(0.85)}"),
        (browns, "rufous", f"{window_gate('h', 41, 82, w)} * {up('C', 22)} * {up('L', 25)} * {down('L', 45)} * {d(0.9)}"),
        (["rufous"], "light_brown", f"{up('L', 45)} * {down('C', 30)} * {d(0.9)}"),
        (["rufous", *browns], "red", f"{red_hue} * {up('C', 12)} * {d(0.85)}"),
        (["rufous", *browns, "green"], "yellow", f"{window_gate('h', 70, 100, w)} * {up('C', 30)} * {d(0.85)}"),
        (["yellow", "rufous", *browns, *grays], "green", f"{window_gate('h', 65, 145, w)} * {up('C', 10)} * {dark_green} * {up('p_green', 0.08, 0.02)} * {green_ratio} * ({d(1)} - {down('h', 80)} * {up('C', 35)}) * {d(0.9)}"),
        (["yellow"], "white", f"{up('L', 85)} * {down('C', 25)} * {d(0.95)}"),
        (["light_brown"], "white", f"{up('L', 58)} * {cream} * {d(0.95)}"),
        (browns, "light_gray", f"{down('C', 12)} * {up('h', 60)} * {d(0.95)} * {light}", "dark_gray", f"{down('C', 12)} * {up('h', 60)} * {d(0.95)} * ({d(1)} - {light})"),
        (browns, "light_gray", f"{up('L', 42)} * {down('C', 20)} * {up('h', 72)} * {up(f'(p_gray / greatest(p_brown, {tiny}))', 0.3, 0.08)} * {d(0.95)}"),
        (["black"], "dark_gray", f"{up('L', 25)} * {d(0.95)}"),
        (["black", "dark_gray"], "blue", f"{window_gate('h', 230, 330, w)} * {up('C', 5)} * {up('p_blue', 0.06, 0.02)} * {d(0.9)}"),
        (["red"], "purple", f"{down('L', 22)} * {down('C', 20)} * {up(f'(p_purple / greatest(p_red, {tiny}))', 0.6, 0.1)} * {d(0.9)}"),
        ([*browns, *grays], "black", f"{down('L', 22)} * {d(0.95)}"),
    ]
    p = ", ".join(f"p_{t}" for t in TERMS)
    held = f"{keep}, L, C, h, {p}, raw"
    q0 = f"SELECT {keep}, L, {CHROMA} AS C, {HUE} AS h, {p}, {raw} AS raw FROM ({lab}) m0"
    sql = f"SELECT {held}, " + ", ".join(f"{base[c]} AS m_{c}" for c in CATEGORIES) + f" FROM ({q0}) m1"
    for i, (donors, *to) in enumerate(transfers):
        gates = [(to[j], f"g{j}") for j in range(0, len(to), 2)]
        gated = f"SELECT {held}, " + ", ".join(f"m_{c}" for c in CATEGORIES) + ", " + ", ".join(f"{to[j + 1]} AS g{j}" for j in range(0, len(to), 2)) + f" FROM ({sql}) a{i}"
        lost = " + ".join(g for _, g in gates)
        given = " + ".join(f"m_{x}" for x in donors)
        value = {c: f"m_{c}" for c in CATEGORIES}
        for c in donors:
            value[c] = f"m_{c} * ({d(1)} - ({lost}))"
        for c, g in gates:
            value[c] = f"{value[c]} + ({given}) * {g}"
        sql = f"SELECT {held}, " + ", ".join(f"{value[c]} AS m_{c}" for c in CATEGORIES) + f" FROM ({gated}) b{i}"
    return f"SELECT {keep}, L, " + ", ".join(f"m_{c}" for c in CATEGORIES) + f" FROM ({sql}) z"
