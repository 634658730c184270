"""Regulatory tables: breakpoints, levels, caps and provider thresholds."""

from __future__ import annotations

# Fixed values of the regulations; concentrations in micrograms per cubic metre.
POLLUTANTS = ("pm2_5", "pm10", "o3", "no2", "so2", "co")
#: The order in which equal sub-indices are told apart.
DOMINANT_ORDER = ("pm2_5", "pm10", "so2", "no2", "co", "o3")

VN_INDEX = ((0, 50), (50, 100), (100, 150), (150, 200), (200, 300), (300, 400), (400, 500))
VN_BREAKPOINTS = {
    "pm2_5": (0, 25, 50, 80, 150, 250, 350, 500),
    "pm10": (0, 50, 150, 250, 350, 420, 500, 600),
    "so2": (0, 125, 350, 550, 800, 1600, 2100, 2630),
    "no2": (0, 100, 200, 700, 1200, 2350, 3100, 3850),
    "co": (0, 10000, 30000, 45000, 60000, 90000, 120000, 150000),
    "o3_1h": (0, 160, 200, 300, 400, 800, 1000, 1200),
    "o3_8h": (0, 100, 120, 170, 210, 400),
}
VN_LABELS = ("Tốt", "Trung bình", "Kém", "Xấu", "Rất xấu", "Nguy hại")

EPA_INDEX = ((0, 50), (51, 100), (101, 150), (151, 200), (201, 300), (301, 500))
EPA_BREAKPOINTS = {
    "pm2_5": (0, 9, 35.4, 55.4, 125.4, 225.4, 325.4),
    "pm10": (0, 54, 154, 254, 354, 424, 604),
    "o3": (0, 108, 140, 170, 210, 400, 600),
    "no2": (0, 100, 189, 677, 1221, 2349, 3853),
    "so2": (0, 92, 197, 484, 797, 1583, 2631),
    "co": (0, 5038, 10763, 14198, 17633, 34694, 57708),
}
EPA_LABELS = ("Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous")
LEVEL_UPPER = (50, 100, 150, 200, 300)
TOP_INDEX = 500.0

PROVIDER_THRESHOLDS = {
    "pm2_5": (10, 25, 50, 75),
    "pm10": (20, 50, 100, 200),
    "no2": (40, 70, 150, 200),
    "o3": (60, 100, 140, 180),
    "so2": (20, 80, 250, 350),
    "co": (4400, 9400, 12400, 15400),
}

STANDARDS = {"VN_1459": (VN_INDEX, VN_BREAKPOINTS, VN_LABELS), "EPA": (EPA_INDEX, EPA_BREAKPOINTS, EPA_LABELS)}


def load_standard(name: str) -> tuple[tuple, dict, tuple]:
    """Index bands, breakpoints and labels of a standard."""
    if name not in STANDARDS:
        raise ValueError(f"unknown standard {name!r}; there are {sorted(STANDARDS)}")
    return STANDARDS[name]


def bands(pollutant: str, standard: str = "VN_1459") -> list[tuple[float, float, float, float]]:
    """(low, high, index low, index high) of each band of a pollutant."""
    index, points, _ = load_standard(standard)
    own = points[pollutant]
    return [(float(a), float(b), float(i), float(j)) for a, b, (i, j) in zip(own, own[1:], index, strict=False)]


def max_plausible() -> dict[str, float]:
    """The largest value kept of each pollutant: its last breakpoint."""
    return {p: float(VN_BREAKPOINTS["o3_1h" if p == "o3" else p][-1]) for p in POLLUTANTS}
