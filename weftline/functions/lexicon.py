"""Word lists and patterns that results depend on."""

# Legal forms of business names.
LEGAL_FORMS = {
    "pvt": "private",
    "ltd": "limited",
    "corp": "corporation",
    "inc": "incorporated",
    "co": "company",
    "llc": "llc",
    "llp": "llp",
    "plc": "plc",
    "se": "societas europaea",
    "sa": "societe anonyme",
    "sas": "societe par actions simplifiee",
    "sarl": "societe a responsabilite limitee",
    "gmbh": "gmbh",
    "ag": "ag",
}

# Abbreviations in addresses.
ADDRESS_WORDS = {
    "rd": "road",
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "bd": "boulevard",
    "bvd": "boulevard",
    "dr": "drive",
    "hwy": "highway",
    "pkwy": "parkway",
    "pl": "place",
    "pt": "point",
    "ln": "lane",
    "ct": "court",
    "sq": "square",
    "ctr": "center",
    "cir": "circle",
    "ter": "terrace",
    "apt": "apartment",
    "no": "number",
    "bldg": "building",
    "fl": "floor",
    "ste": "suite",
    "dist": "district",
    "nr": "near",
    "w": "west",
    "e": "east",
    "n": "north",
    "s": "south",
    "nw": "northwest",
    "ne": "northeast",
    "sw": "southwest",
    "se": "southeast",
}

# Words that token sets leave out.
STOP_WORDS = (
    "the", "and", "of", "in", "on", "at", "for", "to", "a", "an", "is",
    "by", "with", "from", "or", "as", "into", "it",
)

# Words that initialisms and phonetic codes leave out.
ACRONYM_STOP_WORDS = (
    "inc", "ltd", "pvt", "limited", "corp", "corporation", "co", "llc",
    "and", "the", "of", "for", "in", "to", "a", "&", "services", "technologies",
)

# Words that are too common to look up, in the tiered lookup.
GENERIC_TERMS = (
    "the", "and", "ltd", "inc", "llc", "corp", "pvt", "limited", "private",
    "corporation", "null", "nan", "services", "technologies", "solutions",
    "industries", "group", "international", "global", "trading", "enterprises",
    "holdings", "systems", "management", "consulting", "company", "co", "associates",
    "agency", "center", "centre", "club", "sarl", "sasu", "sas", "eurl", "gmbh",
    "sa", "llp", "plc", "cie", "ets",
)

# The same for the single-query lookup.
GENERIC_QUERY_TERMS = (
    "the", "and", "ltd", "inc", "llc", "corp", "pvt", "limited", "private",
    "corporation", "null", "nan", "street", "st", "ave", "road", "rd", "de", "la",
    "services", "technologies", "solutions", "industries", "group", "international",
    "global", "trading", "enterprises", "holdings", "systems", "management", "consulting",
    "company", "co", "associates", "agency", "center", "centre", "club",
)

# Patterns of landmarks and postal codes.
LANDMARK = r"\b(near|nr|opposite|opp|behind|next\s+to)\b"
LANDMARK_PHRASE = r"(?:^|[,;]|\s+)\b(?:near|nr|opposite|opp|behind|next\s+to)\b.*?(?=[,;]|$)"
POSTAL_CODE = r"\b(\d{5,6})\b"

# Fixed value: the countries of the closed routing, and where all others go.
ROUTED_COUNTRIES = ("France", "India", "US")
DEFAULT_ROUTE = "US"

# Settings.
TOP_K = 8
WINDOW_SIZE = 10
MIN_SHARED_TOKENS = 2
MATCH_THRESHOLD = 0.60
MARGIN_RATIO = 0.70
BORDERLINE_THRESHOLD = 0.45
RECOVERY_SIMILARITY = 0.85
RULE_THRESHOLD = 0.70
RULE_MARGIN_RATIO = 0.80
SEED = 42
