"""Fixed values that results depend on: word lists, lookup tables, thresholds,
patterns. They are stated as they are, in their natural order."""

from __future__ import annotations

# Closed enumerations of an analysis record.
ACTIVITIES = ["ice_climbing", "rock_climbing", "sport_climbing", "alpine_climbing", "bouldering", "via_ferrata", "mountaineering", "ski_touring", "ski_resort", "hiking", "trail_running", "cycling", "swimming", "sightseeing", "socialising", "travel", "none", "unknown"]
SCENES = ["mountain_landscape", "rock_face", "glacier", "snow_slope", "forest", "lake", "river", "sea_coast", "beach", "city", "village", "interior", "hut_or_refuge", "food", "people_portrait", "animal", "plant", "vehicle", "document_or_screen", "sign_or_board", "other", "unknown"]
COMPOSITIONS = ["good", "ordinary", "poor", "unknown"]
GAZES = ["all_facing", "some_facing", "none_facing", "no_people", "unknown"]
SEASONS = ["winter", "spring", "summer", "autumn", "unknown"]
TIMES_OF_DAY = ["dawn", "morning", "midday", "afternoon", "dusk", "night", "unknown"]
CONFIDENCE = ["high", "medium", "low"]
EVIDENCE_BASIS = ["sign_in_scene", "printed_page", "landmark_recognition", "generic_inference", "none"]
EVIDENCE_ALIASES = {"text_in_image": "printed_page"}
SCHEMA_VERSION = 4

# How likely a claim is by its basis, and what its confidence does to that.
PEAK_PRIOR = {"sign_in_scene": 0.92, "printed_page": 0.72, "landmark_recognition": 0.28, "generic_inference": 0.05, "none": 0.02}
CONFIDENCE_NUDGE = {"high": 1.1, "medium": 1.0, "low": 0.9}
CORROBORATION_DECAY = 0.6
MAX_SINGLE_CLAIM = 0.95

# Ranks of a photograph's qualities within a duplicate group.
SHARPNESS_RANK = {"sharp": 3, "acceptable": 2, "unknown": 1, "blurry": 0}
GAZE_RANK = {"all_facing": 3, "some_facing": 2, "no_people": 1, "unknown": 1, "none_facing": 0}
COMPOSITION_RANK = {"good": 3, "ordinary": 2, "unknown": 1, "poor": 0}

# Facets of an embedding; labels share a facet's softmax, None means that it does not apply.
FACETS = {
    "people": (0.80, ["people", "people", "people", "people", None, None]),
    "activity": (0.60, ["climbing", "climbing", "ski touring", "hiking", None, None]),
    "terrain": (0.30, ["summit", "ridge", "rock face", "glacier", "lake", "waterfall", "forest", "meadow", "valley", "hut", "tent", "town", "indoors", "indoors", "sea"]),
    "subject": (0.40, ["portrait", "food", "document", "screenshot", None]),
}
BINARY = {"snow": 0.55, "fog": 0.55, "clear sky": 0.55}
UNPLACEABLE = ["document", "screenshot", "food", "indoors", "portrait"]
DOCUMENT_TAGS = ["document", "screenshot"]
SOFTMAX_SCALE = 30.0
PAGE_SCALE = 100.0
PAGE_THRESHOLD = 0.5
PAPERWORK_THRESHOLD = 0.90
MAX_TAGS = 12

# Words of summit names that tell nothing.
STOPWORDS = ["le", "la", "les", "l", "du", "de", "des", "d", "der", "die", "das", "il", "lo", "gli", "dei", "del", "della", "di", "da", "mont", "monte", "mount", "piz", "pizzo", "punta", "pointe", "cima", "spitze", "spitz", "berg", "kogel", "horn", "kopf", "gipfel", "aiguille", "dent", "tete", "grand", "grande", "gross", "grosse", "petit", "petite", "klein", "kleine", "vrch", "stit", "maly"]
# Articles and generic words of place names.
ARTICLES = ["le", "la", "les", "der", "die", "das", "den", "dem", "il", "lo", "gli", "the", "am", "auf", "im", "in", "de", "du", "des", "del", "al", "el", "aux", "zum", "zur", "sur", "sous"]
GENERIC = ["toit", "nid", "puy", "berg", "dent", "pointe", "cima", "punta", "mont", "col", "tete", "tour", "roc", "pic", "haus", "hut", "alp", "see", "val", "hof", "bach", "wald", "feld", "kopf", "horn", "stein", "cresta", "croix"]

# Extensions of images.
STANDARD_IMAGES = [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".heic", ".heif"]
RAW_IMAGES = [".cr2", ".cr3", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".dng", ".orf", ".rw2", ".raf", ".pef", ".raw"]

# Patterns of dates in file names, of climbing grades after a name, of characters unsafe in file names.
FILENAME_DATE = r"(19\d{2}|20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])(?:[-_.T ]?([01]\d|2[0-3])[-_.:]?([0-5]\d)(?:[-_.:]?([0-5]\d))?)?"
GRADE = r"(?:5\.\d{1,2}[a-d]?|[3-9][abc][+-]?|[3-9][+-]|[IVX]{2,5}[+-]?|WI\s?\d|M[3-9]|A[0-5])"
GRADE_END = r"(?![A-Za-z0-9.,])"
UNSAFE_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]

# Bounds of the gazetteer: least and largest latitude, least and largest longitude.
GAZETTEER_BOUNDS = (35.0, 81.0, -25.0, 45.0)

# Thresholds of sessions, trips, near duplicates and agreement.
GAP_HOURS, JUMP_KM, JUMP_MINUTES = 12.0, 15.0, 20.0
TRIP_GAP_HOURS, TRIP_MAX_DAYS = 18.0, 3.0
NEAR_BITS, NEAR_WINDOW_HOURS, NEAR_MIN_BITS, NEAR_MAX_BITS = 4, 24.0, 12, 52
AGREEMENT_KM, MIN_AGREEING, MIN_FRACTION, MIN_PROBABILITY = 25.0, 2, 0.4, 0.5
CONTRADICTION_KM = 30.0
CHUNK_BYTES, CHUNK_ROWS = 1400 * 1024 * 1024, 1000

# Region names too vague to name anything.
VAGUE_REGIONS = ["alps", "alpes", "alpen", "europe", "unknown", "none", "mountains", "the-alps"]
