"""Topic codes and names, stop words, gate schedules."""

# Codes of the topics that get a classifier of their own.
TOPICS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 100]

# Topic names.
TOPIC_NAMES = {
    1: "Macroeconomics",
    2: "Civil Rights",
    3: "Health",
    4: "Agriculture",
    5: "Labor",
    6: "Education",
    7: "Environment",
    8: "Energy",
    9: "Immigration",
    10: "Transportation",
    12: "Law and Crime",
    13: "Social Welfare",
    14: "Housing",
    15: "Domestic Commerce",
    16: "Defense",
    17: "Technology",
    18: "Foreign Trade",
    19: "International Affairs",
    20: "Government Operations",
    21: "Public Lands",
    23: "Culture",
    100: "Other",
}

OTHER_TOPIC = 100

# The Snowball project's English stop word list.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
would should could ought i'm you're he's she's it's we're they're i've you've we've they've
i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't
weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't
cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very
""".split()

# Dashes and quotes deleted from the text.
DELETED_CHARACTERS = "-–—'ʻʼʽ„”\""

# Sample size of a validated topic (95 % confidence, +-0.05, at least 100).
SAMPLE_Z = 1.96
SAMPLE_DELTA = 0.05
SAMPLE_MINIMUM = 100

# Precision gate by round; None accepts only the checked positives.
GATES = {
    "v1": [None, None, 0.75, 0.75, 0.75],
    "v2": [None, None, 0.75, 0.75, 0.75],
    "v3": [0.85, 0.80, 0.75, 0.75, 0.75],
    "v4": [0.85, 0.80, 0.75, 0.75, 0.75],
}

# Names of the variants in reports.
VARIANT_NAMES = {
    "v0": "ml_only",
    "v1": "basic",
    "v2": "basic_enhanced",
    "v3": "balanced",
    "v4": "balanced_active",
}
