"""Word lists.

The first block is fixed: the values decide the results and must stay as they are.
The second block holds our own lists, which a user may replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values ---------------------------------------------------------------------------------

ARCHAIC = [
    "thou", "thee", "thy", "thine", "ye", "hath", "doth", "ere", "wherefore", "whence", "hence",
    "thence", "betwixt", "methinks", "verily", "forsooth", "anon", "mayhap", "perchance", "hither",
    "thither", "yonder",
]

FORMAL = [
    "furthermore", "moreover", "nevertheless", "consequently", "henceforth", "heretofore",
    "notwithstanding", "wherein", "thereby", "thus", "hence", "albeit", "whilst", "aforementioned",
    "pursuant", "whereby", "herein", "thereof", "herewith",
]

INTENSIFIERS = [
    "very", "extremely", "incredibly", "absolutely", "totally", "completely", "utterly", "quite",
    "rather", "so", "too", "really", "truly", "highly", "exceptionally", "extraordinarily",
]

SLANG = [
    "gonna", "wanna", "gotta", "kinda", "sorta", "yeah", "nope", "yep", "lol", "omg", "btw", "fyi",
    "idk", "tbh", "imo", "imho",
]

MODALS = ["can", "could", "may", "might", "shall", "should", "will", "would", "must", "ought"]

DISCOURSE = [
    "however", "therefore", "furthermore", "moreover", "nevertheless", "nonetheless", "meanwhile",
    "consequently", "thus", "hence", "additionally", "alternatively", "conversely", "likewise",
    "similarly", "specifically", "namely", "indeed", "naturally", "certainly", "obviously", "clearly",
    "arguably", "presumably",
]

POLITENESS = [
    "please", "thank", "thanks", "grateful", "appreciate", "kindly", "excuse", "pardon", "sorry",
    "apologize", "would you", "could you", "may i", "if you don't mind",
]

RHETORICAL = ["why ", "how could", "who knows", "what if", "isn't it"]

NARRATIVE = ["said", "told", "walked", "looked", "felt", "went", "came", "saw"]

ANALYTICAL = ["therefore", "thus", "consequently", "analysis", "conclude", "demonstrate"]

CONJUNCTIONS = ["and", "but", "or", "nor", "yet", "so"]

SUBORDINATORS = ["because", "although", "if", "when", "while", "since", "unless"]

STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "that",
    "which", "this", "have", "upon", "from", "were", "been", "there", "very", "is", "it", "as", "be",
    "are", "was", "one", "all", "would", "their", "what", "so", "when", "can", "had", "not", "your",
    "said", "each", "do", "time", "if", "will", "how", "about", "may", "its", "only", "out", "other",
    "also", "after", "use", "two", "then", "first", "any", "these", "new", "no", "between", "now",
    "just", "where", "most", "some", "them", "same", "our", "than", "into", "has", "look", "before",
    "even", "much", "own", "want", "him", "way", "find", "give", "day", "us",
]

# Our own lists --------------------------------------------------------------------------------

# Closed-class words and a few irregular verbs by tag; each word stands under one tag.
POS_WORDS = {
    "DET": "the a an this these those each every some any all both another such",
    "PRON": (
        "i you he she it we they me him her us them my your his its our their mine yours hers ours "
        "theirs myself yourself himself herself itself themselves who whom whose what which "
        "someone everyone nobody something nothing"
    ),
    "ADP": (
        "of in on at by with from into upon about between through during before after above below "
        "under over against among within without across behind beyond near for"
    ),
    "CCONJ": "and but or nor yet",
    "SCONJ": "because although if when while since unless that than whether",
    "AUX": (
        "am is are was were be been being has have had do does did will would shall should can could "
        "may might must"
    ),
    "PART": "to not",
    "ADV": "very so too quite rather now then here there never always often also just only even however therefore thus hence",
    "INTJ": "yes no oh please",
    "VERB": "said told went came saw felt made took gave found knew thought says goes comes makes takes gives",
}
POS_WORDS = {tag: terms.split() for tag, terms in POS_WORDS.items()}

# Endings tried in this order for words of no closed class, with the least number of characters
# before the ending; the rest are nouns.
POS_ENDINGS = [
    ("ADV", 1, ["ly"]),
    ("ADJ", 1, ["ous", "ful", "less", "able", "ible", "ive", "ish", "al", "ic"]),
    ("VERB", 2, ["ing", "ed", "ize", "ise", "ify", "ate"]),
]

PAST_VERBS = ["said", "told", "went", "came", "saw", "felt", "made", "took", "gave", "found", "knew", "thought"]
PRESENT_VERBS = ["says", "goes", "comes", "makes", "takes", "gives"]

# Tags whose tokens hang on their right neighbour in the attachment rule.
ATTACH_RIGHT = ["DET", "ADJ", "NUM", "ADP", "AUX", "ADV", "PART"]

# Our own judgement on a coarse scale, not taken from any published list: valence in tenths (weak 10,
# plain 20, strong 30), polarity and subjectivity in hundredths (in quarters), emotion.
SENTIMENT = [
    ("good", 20, 50, 50, "joy"),
    ("great", 30, 75, 75, "joy"),
    ("happy", 30, 75, 100, "joy"),
    ("love", 30, 75, 75, "joy"),
    ("best", 30, 100, 50, "joy"),
    ("kind", 20, 50, 75, "joy"),
    ("free", 20, 25, 50, "joy"),
    ("please", 10, 25, 25, "neutral"),
    ("calm", 10, 25, 50, "neutral"),
    ("wonder", 20, 25, 75, "surprise"),
    ("sudden", -10, 0, 50, "surprise"),
    ("strange", -10, -25, 50, "surprise"),
    ("bad", -20, -50, 75, "sadness"),
    ("sad", -20, -50, 100, "sadness"),
    ("lost", -10, -25, 50, "sadness"),
    ("alone", -10, -25, 75, "sadness"),
    ("fear", -20, -50, 75, "fear"),
    ("afraid", -20, -50, 100, "fear"),
    ("dark", -10, -25, 50, "fear"),
    ("hate", -30, -75, 100, "anger"),
    ("anger", -30, -75, 75, "anger"),
    ("wrong", -20, -50, 75, "anger"),
    ("ugly", -20, -50, 100, "disgust"),
    ("foul", -20, -50, 75, "disgust"),
]

NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "without", "cannot"]
BOOSTERS = INTENSIFIERS
DAMPENERS = ["almost", "barely", "hardly", "kinda", "sorta", "slightly", "somewhat", "partly"]


def literal_table(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A small table written as literals, so that Spark knows its size when it picks a join."""

    def literal(value) -> str:
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in schema.items())
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(schema)})")


def sentiment_table(spark: SparkSession) -> DataFrame:
    """``(term, valence, polarity, subjectivity, emotion)``; tenths and hundredths as integers."""
    schema = {"term": "string", "valence": "bigint", "polarity": "bigint", "subjectivity": "bigint", "emotion": "string"}
    return literal_table(spark, SENTIMENT, schema)
