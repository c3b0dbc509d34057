"""Fixed values the harmonised tables rely on: label maps, patterns, outcome columns."""

REGION = "birth_region_standardized"

# Outcome columns and their display labels.
OUTCOMES = {
    "employment_rate": "Employment Rate (%)",
    "median_income": "Median Income (SEK)",
    "self_sufficiency_rate": "Self-Sufficiency Rate (%)",
    "welfare_recipients_pct": "Welfare Recipients (%)",
    "welfare_amount_avg": "Avg Welfare Amount (SEK)",
}

# Label of birth region (lower case) to category.
BIRTH_REGIONS = {
    "born in sweden": "Sweden",
    "sweden": "Sweden",
    "sverige": "Sweden",
    "all regions of birth": "Total",
    "foreign born": "Foreign Born (Total)",
    "foreign-born total": "Foreign Born (Total)",
    "foreign-born": "Foreign Born (Total)",
    "nordic countries excluding sweden": "Nordic (excl. Sweden)",
    "nordic countries except sweden": "Nordic (excl. Sweden)",
    "eu excluding nordic countries": "EU/EFTA (excl. Nordic)",
    "eu28 except nordic countries": "EU/EFTA (excl. Nordic)",
    "eu27_2020 except nordic countries": "EU/EFTA (excl. Nordic)",
    "europe except eu and the nordic countries": "Europe (excl. EU/EFTA)",
    "europe except eu28 and nordic countries": "Europe (excl. EU/EFTA)",
    "europe except eu27_2020 and nordic countries": "Europe (excl. EU/EFTA)",
    "africa": "Africa",
    "asia": "Asia",
    "north america": "North America",
    "south america": "South America",
    "oceania": "Oceania",
    "soviet union": "Europe (excl. EU/EFTA)",
    "unknown": "Other",
    "inrikes födda": "Sweden",
    "utrikes födda": "Foreign Born (Total)",
}

# Nationality (lower case) to category.
NATIONALITIES = {
    "syrien": "Asia",
    "irak": "Asia",
    "afghanistan": "Asia",
    "eritrea": "Africa",
    "somalia": "Africa",
    "etiopien": "Africa",
    "marocko": "Africa",
    "turkiet": "Asia",
    "iran": "Asia",
    "pakistan": "Asia",
    "indien": "Asia",
    "kina": "Asia",
    "thailand": "Asia",
    "usa": "North America",
    "chile": "South America",
    "colombia": "South America",
    "polen": "EU/EFTA (excl. Nordic)",
    "tyskland": "EU/EFTA (excl. Nordic)",
    "ryssland": "Europe (excl. EU/EFTA)",
    "ukraina": "Europe (excl. EU/EFTA)",
    "finland": "Nordic (excl. Sweden)",
    "danmark": "Nordic (excl. Sweden)",
    "norge": "Nordic (excl. Sweden)",
    "island": "Nordic (excl. Sweden)",
}

# Rows kept by a statistics scan, per column that exists.
STATISTICS_FILTERS = {
    "region": "Sweden|Riket",
    "sex": "total",
    "age": "total|15-74|20-64",
    "number_of_years_in_sweden": "total",
}

# Indicator to (value name, preferred measure, fallback measure).
INDICATORS = {
    "employment": ("employment_rate", "employment rate", "number of employed"),
    "income": ("median_income", "Median value", None),
    "self_sufficiency": ("self_sufficiency_rate", "rate|Självförsörjandegrad", "Number of self-sufficient"),
}

# Labels that mean a total row.
STATISTICS_TOTALS = ("total", "all regions", "all regions of birth")
COUNT_TOTALS = ("total", "summa", "samtliga")
PLOT_EXCLUDED = ("Total", "Other")

# File-name fragments per count kind, and fragments that rule a file out.
FILE_FRAGMENTS = {"asylum": ("asyl", "avgjorda"), "permits": ("uppehåll", "arbet", "beviljade")}
FILE_EXCLUDED = {"asylum": (), "permits": ("asyl",)}

# Fragments that name a role in a workbook.
SHEET_FRAGMENTS = ("medborgar", "nationality")
SHEET_PREFERRED = ("första", "frsta")
NATIONALITY_FRAGMENTS = ("medborgar", "nation")
COUNT_FRAGMENTS = ("total", "beviljade", "avgjorda", "summa")
YEAR_FRAGMENTS = ("år", "year")
NATIONALITY_MAX_LENGTH = 60

# Birth-region rules of the welfare table, first hit wins.
WELFARE_REGION_FRAGMENTS = ("föd", "born", "inrikes")
WELFARE_RULES = ((("inrikes", "sweden"), "Sweden"), (("utrikes", "foreign"), "Foreign Born (Total)"))
