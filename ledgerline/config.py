"""Run parameters: phase calendars, policy year, caps, bins and labels.

Two rule families exist side by side (the "python" rules and the "r" rules of the
source analysis); both are legitimate reports, so every operator that differs takes
a :class:`Preset` instead of hard-coding one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Phase:
    label: str
    lo: int
    hi: int | None  # None = open upper bound


@dataclass(frozen=True)
class Preset:
    name: str
    phases: tuple[Phase, ...]
    policy_year: int
    max_year: int
    amount_cap: float
    density_cap: float
    share_rule: str  # "left" = [0,20)..[80,100), 100 -> NULL ; "right" = <=19,..,>79
    missing_label: str
    outside_prefix: str = "Fora"
    change_year: int | None = None  # "r" rules: extra change flag from this year on
    top_investors: int = 20
    top_regions: int = 7
    shift_top: int = 7
    min_phase_rows: int = 50
    min_mediation_rows: int = 80
    # rows of one block of the ordered features (rolling windows, prefix sums)
    rows_per_block: int = 1_000_000
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def labels(self) -> list[str]:
        return [p.label for p in self.phases]


# Fixed values taken from the source analysis (published calendar, policy year, caps).
PUBLISHED = Preset(
    name="published",
    phases=(Phase("GG_1.0", 2005, 2012), Phase("GG_2.0", 2013, 2016), Phase("GG_3.0_ERP", 2017, 2024)),
    policy_year=2017,
    max_year=2024,
    amount_cap=1100.0,
    density_cap=1200.0,
    share_rule="left",
    missing_label="Missing",
)

PUBLISHED_R = Preset(
    name="published_r",
    phases=(Phase("Going_Global1.0", 2005, 2011), Phase("Going_Global2.0", 2012, 2016),
            Phase("Going_Global3.0", 2017, 2024)),
    policy_year=2017,
    max_year=2024,
    amount_cap=1100.0,
    density_cap=1200.0,
    share_rule="right",
    missing_label="Unknown",
    change_year=2016,
)

# Calendars re-based onto the driver tables (order years 1995-2001), see FIXTURES.md.
PRESET_A = Preset(
    name="preset_a",
    phases=(Phase("p1", 1995, 1997), Phase("p2", 1998, 1999), Phase("p3", 2000, 2001)),
    policy_year=2000,
    max_year=2024,
    amount_cap=300000.0,
    density_cap=320000.0,
    share_rule="left",
    missing_label="Missing",
)

PRESET_B = Preset(
    name="preset_b",
    phases=(Phase("Going_Global1.0", 1995, 1996), Phase("Going_Global2.0", 1997, 1999),
            Phase("Going_Global3.0", 2000, 2001)),
    policy_year=2000,
    max_year=2024,
    amount_cap=320000.0,
    density_cap=320000.0,
    share_rule="right",
    missing_label="Unknown",
    change_year=1999,
)

# Fixed token lists of the source analysis.
GREENFIELD_TOKENS = ["G", "GREENFIELD", "1", "Y", "YES", "SIM", "TRUE"]
BRI_TOKENS = ["1", "bri", "y", "yes", "sim", "true"]
MISSING_TOKENS = ["nan", "None", "", " "]
# Country-name map, 9 fixed entries, as given (keys: dimension spelling, values: replacement).
COUNTRY_MAP = {
    "United States of America": "United States",
    "United Kingdom": "United Kingdom",
    "South Korea": "Korea, Rep.",
    "Russia": "Russian Federation",
    "Czechia": "Czech Republic",
    "Hong Kong SAR, China": "Hong Kong",
    "Iran": "Iran, Islamic Rep.",
    "Egypt": "Egypt, Arab Rep.",
    "Slovakia": "Slovak Republic",
}
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]
HHI_BANDS = (1500.0, 2500.0)
HHI_BAND_LABELS = ("unconcentrated", "moderately concentrated", "highly concentrated")
