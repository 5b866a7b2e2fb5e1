"""Units of grades and metal, and roles of columns by their names."""

from __future__ import annotations

import re

# Factors from a grade in its unit to a fraction, and from tonnes to a unit of metal.
GRADE_FACTORS = {"raw": 1.0, "%": 0.01, "ppm": 1e-6, "ppb": 1e-9, "g/t": 1e-6, "oz/t": 3.11035e-5}
TONNAGE_DIVISORS = {"t": 1.0, "kt": 1e3, "Mt": 1e6}
METAL_DIVISORS = {"t": 1.0, "kt": 1e3, "Mt": 1e6, "kg": 1e-3, "oz": 3.11034768e-5, "koz": 3.11034768e-2, "Moz": 31.1034768, "lb": 4.5359237e-4, "klb": 0.45359237, "Mlb": 453.59237}
UNIT_SUFFIXES = (
    ("ppm", r"[_\s(]ppm\)?$"),
    ("ppb", r"[_\s(]ppb\)?$"),
    ("%", r"([_\s](pct|perc|prcnt)|\(%\)|_%)$"),
    ("g/t", r"([_\s]gt|\(g/t\))$"),
    ("oz/t", r"([_\s](opt|ozt)|\(oz/t\))$"),
)
# What coordinate and block size columns are called, most telling first.
COORDINATES = {
    "x": (r"^x$", r"^xc$", r"^x[_-]?cent(re|er)?$", r"^mid[_-]?x$", r"^centroid[_-]?x$", r"^east(ing)?$", r"^x[_-]?coord$", r"^xcenter$", r"^xmid$", r"^xblock$"),
    "y": (r"^y$", r"^yc$", r"^y[_-]?cent(re|er)?$", r"^mid[_-]?y$", r"^centroid[_-]?y$", r"^north(ing)?$", r"^y[_-]?coord$", r"^ycenter$", r"^ymid$", r"^yblock$"),
    "z": (r"^z$", r"^zc$", r"^z[_-]?cent(re|er)?$", r"^mid[_-]?z$", r"^centroid[_-]?z$", r"^elev(ation)?$", r"^rl$", r"^z[_-]?coord$", r"^zcenter$", r"^zmid$", r"^zblock$", r"^level$", r"^bench$"),
}
BLOCK_SIZES = {
    "dx": (r"^dx$", r"^xinc$", r"^xdis$", r"^xsize$", r"^dimx$", r"^xlen$", r"^x[_-]?dim$", r"^x[_-]?size$", r"^d[_-]?x$", r"^size[_-]?x$"),
    "dy": (r"^dy$", r"^yinc$", r"^ydis$", r"^ysize$", r"^dimy$", r"^ylen$", r"^y[_-]?dim$", r"^y[_-]?size$", r"^d[_-]?y$", r"^size[_-]?y$"),
    "dz": (r"^dz$", r"^zinc$", r"^zdis$", r"^zsize$", r"^dimz$", r"^zlen$", r"^z[_-]?dim$", r"^z[_-]?size$", r"^d[_-]?z$", r"^size[_-]?z$"),
}


def sniff_unit(name: str) -> str:
    """Unit that a column's name ends in, else ``raw``."""
    for unit, pattern in UNIT_SUFFIXES:
        if re.search(pattern, name.strip(), re.I):
            return unit
    return "raw"


def guess_roles(numeric_columns: list[str], roles: dict[str, tuple[str, ...]] = COORDINATES) -> dict[str, str]:
    """First column that the earliest pattern of each role hits; with no coordinate at all, the first three columns."""
    found = {}
    for role, patterns in roles.items():
        hits = (c for p in patterns for c in numeric_columns if re.match(p, c.strip(), re.I))
        if (hit := next(hits, None)) is not None:
            found[role] = hit
    if not found and roles is COORDINATES:
        found = dict(zip("xyz", numeric_columns))
    return found
