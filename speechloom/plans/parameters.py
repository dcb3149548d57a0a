"""Parameters that the registered queries and their SQL share."""

from speechloom import fixed_values as fv

PHRASE, OTHER_PHRASE = "of the", "and the"
WILDCARD = "the%of_the"
ANY_PHRASES = ["of the", "license"]
SPEECH_ID, SESSION, REPAIRED_SESSION, SEED = "7", 81, 81, 42

PURGE_PHRASES = ["the the", "of the", "and the", *fv.PURGE_PHRASES]
INTRO_PHRASES = ["of the", "license", *fv.INTRO_PHRASES]
NOISE_BIGRAMS = ["the the", "the of", "of the", "and the"]
STOP_WORDS = "the of and to in a is that it for".split()
CONTEXT_STOP_WORDS = ["with", "from"]

VOCABULARY = [*fv.POLICY_VOCABULARY, "the", "was", "with", "from", "of the"]
CATEGORIES = {**fv.POLICY_CATEGORIES, "Function": ["was", "with", "from", "was with", "de la"]}
# Ids are taken modulo this number in the tables of repeated ids.
REPEATED_IDS = 100
# Buckets of the table by id, and the id that a third of its rows share.
BUCKETS, HOT_ID = 8, "3"
# One description and one speaker in so many carry that id, too.
REPEATED_DESCR, REPEATED_SPEAKERS = 200, 250
# Groups of a session in the table with an index of phrases.
GROUPS, RARE_PHRASE, RARE_WILDCARD = 4, "MIT License", "gnu%public_license"
# What the configuration files hold.
CONFIG_LIST, CONFIG_CATEGORIES = "procedural_bigrams", 7
# Terms of the trained model that are shown.
MODEL_TERMS = 200
ROLES = ["user", "assistant", "system"]

GAZETTEER = [
    ("the", "ORG"), ("and", "GPE"), ("of the", "LAW"), ("license", "PRODUCT"),
    ("licensed under the apache license version", "LAW"),
    ("this work is licensed under the gnu general", "LAW"),
    ("with", "PERSON"), ("was", "DATE"), ("de la", "GPE"), ("and the of", "EVENT"),
    ("cc by-sa 4.0", "LAW"), ("license, version 2.0", "LAW"), ("public-license", "EVENT"), ("o'brien", "PERSON"),
]
ENTITY_STOPS = ["and", "mr speaker"]
POLICY_TERMS = [("license", "Justice"), ("with", "Budget/Tax"), ("of the", "Infrastructure"),
                ("cc by-sa 4.0", "Justice")]

MERGED_LIST = "de"
LEXICON = [
    *[
        ("policy", category, f"Terms on {category}", i, term)
        for category, listed in fv.POLICY_CATEGORIES.items()
        for i, term in enumerate(listed)
    ],
    *[
        ("policy", "Function words", None, i, term)
        for i, term in enumerate("The Of And To In A Is That It For With From".split())
    ],
    *[
        ("denoising", "licence_lines", None, i, term)
        for i, term in enumerate(
            ["Released_under_the_MIT_License.", "licensed under CC BY-NC 4.0", "GNU General Public License"]
        )
    ],
    *[("denoising", "procedural_bigrams", None, i, t) for i, t in enumerate(NOISE_BIGRAMS)],
    *[("denoising", "procedural_stopwords", None, i, t) for i, t in enumerate(PURGE_PHRASES)],
]

DONE_URL_PART, REVISED_URL_PART, REVISED_TEXT = "/fr/", "/en/", "<p>Revised &amp; extended.</p>"

PROFILED_TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
