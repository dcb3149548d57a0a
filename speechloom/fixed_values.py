"""Fixed values.

Everything in this module is a constant that results depend on: word lists,
phrases, patterns, column orders, fill values and thresholds. They are data,
kept together and in plain text; every operator that uses one takes it as a
parameter with the value below as its default.
"""

# ---------------------------------------------------------------- columns

PRODUCTION_COLUMNS = [
    "speech_id", "speech", "date", "speakerid", "speaker", "is_mapped",
    "party", "state_x", "lastname", "firstname", "congress_session",
]

REPAIR_COLUMNS = [
    "speech_id", "speech", "date", "party", "state_x", "lastname",
    "firstname", "congress_session",
]

CARD_COLUMNS = [
    "speech_id", "date", "speaker", "party", "state_x", "speech",
    "congress_session", "is_procedure",
]

PRODUCTION_FILL = {
    "speakerid": -1,
    "speaker": "Unknown Speaker",
    "lastname": "Unknown",
    "firstname": "Unknown",
    "party": "Unknown",
    "state_x": "Unknown",
    "speech": "[No Text]",
}

REPAIR_FILL = {
    "lastname": "Unknown",
    "firstname": "Unknown",
    "party": "Unknown",
    "state_x": "Unknown",
    "speech": "[No Text]",
    "date": 0,
}

# Strings that the delimited reader treats as missing.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

FIRST_SESSION, LAST_SESSION = 43, 114

MAIN_PARTIES = ["D", "R"]
PARTY_NAMES = {"D": "Democrat", "R": "Republican"}

# ----------------------------------------------------------------- ingest

FLOOR_MARKERS = ["PgH", "PgS", "PGH", "PGS"]
MATTER_MARKERS = ["FrontMatter", "BackMatter"]
MIN_GRANULE_CHARS = 50
NAME_WINDOW_CHARS = 50

METADATA_KEYS = ["authority-fnf", "authority-lnf", "name", "#text", "value"]

# Header and footer patterns, applied in this order: (pattern, ignore case).
BOILERPLATE_PATTERNS = [
    (r"\[?Congressional Record[,]? Volume \d+.*?\]", True),
    (r"\[(Senate|House|Extensions of Remarks|Daily Digest)\]", True),
    (r"\[?Pages? [HSE]?\d+(-[HSE]?\d+)?\]?", True),
    (r"\([A-Z][a-z]+, [A-Z][a-z]+ \d{1,2}, \d{4}\)", False),
    (r"From the Congressional Record Online.*?gpo\.gov", True),
]

# What may be left dangling at the start of a text, and anywhere in it.
DANGLING_START_PATTERN = r"^[\s\]\)]+"
DANGLING_PAIR_PATTERN = r"\]\s*\]"

# The opening words of a floor speech that name its speaker.
OPENING_NAME_PATTERN = r"^(Mr\.|Ms\.|Mrs\.|The)\s+([A-Za-z\s]+)(\.|:)"
OPENING_STATE_PATTERN = r"\s+of\s+[A-Za-z]+$"

# --------------------------------------------------------------- denoising

PURGE_PHRASES = [
    "yield back", "yield the floor", "without objection", "so ordered",
    "move to adjourn", "clerk will report", "recognize the gentleman",
    "recognize the gentlewoman", "unanimous consent",
    "ask for the yeas and nays", "quorum call", "resume consideration",
    "motion to reconsider", "mr. speaker", "madam speaker", "mr. president",
    "madam president",
]
PURGE_MAX_CHARS = 500

PROCEDURE_LABEL = "administrative procedure"
DEBATE_LABEL = "political debate"
CONFIDENCE_THRESHOLD = 0.70
ROWS_PER_MINUTE = 6400

INTRO_PHRASES = ["unanimous consent", "quorum call", "pledge of allegiance"]
INTRO_CHARS = 150
SUBSTANTIVE_MIN_CHARS = 500

BIGRAM_MIN_WORDS = 10
BIGRAM_NOISE_SHARE = 0.30

QUALITY_MIN_CHARS = 1000
QUALITY_BATCH = 20

# ------------------------------------------------------------- term mining

CONGRESS_STOPWORDS = """
absent adjourn ask can chairman committee con democrat etc gentleladies
gentlelady gentleman gentlemen gentlewoman gentlewomen hereabout hereafter
hereat hereby herein hereinafter hereinbefore hereinto hereof hereon hereto
heretofore hereunder hereunto hereupon herewith month mr mrs nai nay none now
part per pro republican say senator shall sir speak speaker tell thank
thereabout thereafter thereagainst thereat therebefore therebeforn thereby
therefor therefore therefrom therein thereinafter thereof thereon thereto
theretofore thereunder thereunto thereupon therewith therewithal today
whereabouts whereafter whereas whereat whereby wherefore wherefrom wherein
whereinto whereof whereon whereto whereunder whereupon wherever wherewith
wherewithal will yea yes yield
""".split()

STANDARD_STOPWORDS = """
the to of and a in that is it for be on with as this was by not i from are
which he his at has but or an they their we so been there if all any my me no
upon one more would could should than them who said him what
""".split()

STRICT_STOPWORDS = """
have had were was been being has did does their them this that these those
which who whom whose what when where why how bill house senate senator states
government committee gentleman gentlemen mr mrs speaker shall should would
could may might must can will very more most other some such than then there
here any all every each now today question time its said say saying tell asked
ordered provide under into upon after before member
""".split()

STRICT_PROCEDURAL = "adjourn absent nai nay yea yes yield pro con".split()

BIGRAM_NOISE_WORDS = """
gentleman committee mr question amendment order ask house senator vote senate
speaker chairman shall said will say make time president
""".split()

BOILERPLATE_BIGRAMS = [
    "united states", "yeas nays", "unanimous consent", "morning hour",
    "paired colleague", "yes sir", "joint resolution", "district columbia",
    "proceed consideration", "000 000", "ordered lie", "table motion",
    "pending bill", "ordered printed", "previous question",
    "referred committee",
]

STATE_STOPWORDS = [
    "new york", "north carolina", "west virginia", "rhode island",
    "south carolina", "new jersey", "new hampshire", "mississippi",
    "louisiana", "pennsylvania", "massachusetts", "virginia", "maryland",
    "ohio", "illinois", "kentucky",
]

DEEP_CLEAN_PHRASES = [
    "united states", "yeas nays", "unanimous consent", "morning hour",
    "paired colleague", "yes sir", "joint resolution", "district columbia",
    "proceed consideration", "000 000", "new york", "north carolina",
    "west virginia", "rhode island", "south carolina", "new jersey",
    "new hampshire", "house representatives", "presiding officer",
    "previous question", "referred committee", "lie table", "ordered printed",
]

DEEP_CLEAN_STOPWORDS = """
gentleman senator speaker chairman committee amendment house senate mr
president order question yesterday tomorrow bill resolution ask yield time
member
""".split()

POLICY_CATEGORIES = {
    "Economy/Money": [
        "silver", "gold", "currency", "coinage", "bank", "treasury",
        "resumption",
    ],
    "Defense/Army": [
        "army", "military", "officer", "war", "pension", "defense", "soldier",
    ],
    "Infrastructure": [
        "railroad", "bridge", "river", "harbor", "public lands",
        "post office",
    ],
    "Budget/Tax": [
        "appropriation", "revenue", "tax", "deficit", "spending",
        "internal revenue",
    ],
    "Justice": [
        "court", "judge", "justice", "district", "law", "civil rights",
    ],
}

POLICY_VOCABULARY = [
    "silver", "gold", "currency", "coinage", "bank", "treasury",
    "resumption", "army", "military", "war", "pension", "soldier", "veteran",
    "appropriation", "revenue", "tax", "deficit", "railroad", "bridge",
    "river", "harbor", "public lands", "post office", "court", "justice",
    "law", "civil rights",
]

ANY_PHRASES = ["silver", "gold"]

CONTEXT_WINDOW = 5
CONTEXT_SAMPLE = 200
CONTEXT_STOPWORDS = ["the", "and", "that", "this", "was", "for"]
CONTEXT_MIN_CHARS = 4

# ---------------------------------------------------------------- entities

STANDARD_ENTITY_LABELS = ["ORG", "GPE", "LAW", "NORP"]
POLICY_SOURCE, MODEL_SOURCE = "Policy Filter", "NER Model"

# ------------------------------------------------------------- key phrases

# The share of a group's documents a term may be in, the number it must be in,
# and how many terms of a group are shown.
UNIGRAM_MAX_DF, UNIGRAM_MIN_DF, UNIGRAM_TOP = 0.7, 5, 10
BIGRAM_MAX_DF, BIGRAM_MIN_DF, BIGRAM_TOP = 0.5, 10, 10
BIGRAM_FINAL_MAX_DF, BIGRAM_FINAL_MIN_DF, BIGRAM_FINAL_TOP = 0.4, 5, 12
DEEP_CLEAN_MAX_DF, DEEP_CLEAN_MIN_DF, DEEP_CLEAN_TOP = 0.3, 10, 10

# ------------------------------------------------- reasons and placeholders

NOT_FLOOR = "Not Floor Speech"
MATTER = "Front/BackMatter"
EMPTY = "Empty/Header Only"
NO_METADATA = "Metadata Fail"
NO_LINK = "No Text Link"
NO_TEXT = "Text Download Fail"

UNKNOWN, UNKNOWN_SPEAKER, NOT_AVAILABLE = "Unknown", "Unknown Speaker", "N/A"
PROCEDURE_BADGE, DEBATE_BADGE, UNLABELLED_BADGE = "PROCEDURE", "DEBATE", "UNCERTAIN"
