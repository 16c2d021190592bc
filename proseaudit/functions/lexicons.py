"""Word lists, phrases and constants.

Fixed values: results depend on exactly these entries, so they are listed in plain order and used
as they are. ``LEAD_WORD`` is the organisation's own name in file and template names; it is a
parameter everywhere and this is only the default.
"""

LEAD_WORD = "acme"
BRAND_FONT = "Lato"

# --- fixed values: contractions and their expansions -------------------------------------------
CONTRACTIONS = {
    "aren't": "are not", "can't": "cannot", "couldn't": "could not", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hasn't": "has not",
    "haven't": "have not", "isn't": "is not", "it's": "it is", "shouldn't": "should not",
    "that's": "that is", "there's": "there is", "they're": "they are", "wasn't": "was not",
    "we're": "we are", "weren't": "were not", "won't": "will not", "wouldn't": "would not",
    "you're": "you are",
}

# --- fixed values: preferred terms ---------------------------------------------------------------
PREFERRED_TERMS = {
    "artificial intelligence": "Artificial Intelligence",
    "built in": "built-in",
    "code-sets": "code sets",
    "codesets": "code sets",
    "cyber attacks": "cyberattacks",
    "cyber security": "cybersecurity",
    "cyber-attacks": "cyberattacks",
    "cyber-security": "cybersecurity",
    "health care": "healthcare",
    "machine learning": "Machine Learning",
    "natural language processing": "Natural Language Processing",
    "public-sector": "public sector",
    "user friendly": "user-friendly",
    "web based": "web-based",
}

# --- fixed values: number words ------------------------------------------------------------------
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_word(n: int) -> str:
    """English words for 0..99."""
    if n < len(UNITS):
        return UNITS[n]
    tens, unit = TENS[n // 10 - 2], n % 10
    return f"{tens}-{UNITS[unit]}" if unit else tens


# --- fixed values: negation, hedging, passive ------------------------------------------------------
NEGATORS = (
    "not no never hardly barely scarcely rarely seldom without lack lacks lacking can't cannot won't "
    "don't doesn't didn't isn't aren't wasn't weren't hasn't haven't hadn't shouldn't wouldn't "
    "couldn't mustn't ain't"
).split()
HEDGES = (
    "might be", "could be", "would be", "should be", "may be", "probably", "perhaps", "maybe",
    "sort of", "kind of", "looking for", "looking to",
)
BE_FORMS = ("is", "are", "was", "were", "been", "being")
NEUTRAL_DOMAIN_WORDS = (
    "exploit", "governance", "risk", "risks", "threat", "threats", "weakness", "weaknesses",
)
LIMITATION_MARKS = ("lack", "limited", "no ", "not ", "unable", "insufficient", "cannot")
WEAKNESS_MARKS = (
    "limited", "lack", "no ", "not ", "unable", "insufficient", "without", "constrained", "shortage", "gap",
)
STRENGTH_MARKS = (
    "strong", "robust", "capable", "provide", "deliver", "achieve", "successful", "effective",
    "established", "has ",
)
TECH_TERMS = ("AI", "ML", "API", "BPA", "HITRUST", "SWOT", "IT", "FWA", "LLM", "EPS")

# --- fixed values: usage ---------------------------------------------------------------------------
VAGUE_TIMES = ("currently", "at this time", "presently", "right now", "at present")
GENDERED_TERMS = (
    "guys", "waitress", "waiter", "chairman", "chairwoman", "mankind", "manpower", "policeman",
    "fireman", "mailman", "stewardess",
)
GENDERED_PRONOUNS = ("he", "she", "his", "her", "him", "himself", "herself")
DISABILITY_PHRASES = (
    "is disabled", "are disabled", "disabled person", "disabled people", "handicapped",
    "wheelchair-bound", "suffering from",
)
PEOPLE_QUALIFIERS = ("instead", "rather", "first", "centered", "centric")

# --- fixed values: rewrites, applied in this order ---------------------------------------------------
# A space in a phrase stands for any run of white space.
POSITIVE_REWRITES = (
    ("can't", "cannot"),
    ("not able to", "unable to"),
    ("do not have", "lack"),
    ("does not have", "lacks"),
    ("not enough", "insufficient"),
    ("no significant", "limited"),
)
# in this order; None drops the word and the space after it
HEDGE_STEPS = (
    ("might be", "is"), ("could be", "is"), ("would be", "is"), ("should be", "is"), ("may be", "is"),
    ("probably", None), ("perhaps", None), ("maybe", None), ("sort of", None), ("kind of", None),
    ("looking for", "seek"), ("looking to", "seeking to"),
)
PASSIVE_REWRITES = (
    ("created", "creates"), ("developed", "develops"), ("built", "builds"),
    ("used", "uses"), ("needed", "needs"), ("applied", "applies"),
)
SPECIFICITY_REWRITES = (
    ("currently", "[as of Month Year]"),
    ("at this time", "[as of specific date]"),
    ("presently", "[as of Month Year]"),
    ("right now", "[as of Month Year]"),
    ("people", "[specific group]"),
)
INCLUSIVE_REWRITES = (
    ("guys", "people"),
    ("chairman", "chairperson"),
    ("chairwoman", "chairperson"),
    ("waitress", "server"),
    ("waiter", "server"),
    ("mankind", "humanity"),
    ("manpower", "workforce"),
    ("policeman", "police officer"),
    ("fireman", "firefighter"),
    ("mailman", "mail carrier"),
    ("stewardess", "flight attendant"),
    ("is disabled", "has a disability"),
    ("are disabled", "have disabilities"),
    ("disabled person", "person with a disability"),
    ("handicapped", "person with a disability"),
    ("wheelchair-bound", "uses a wheelchair"),
)

# --- fixed values: dates ------------------------------------------------------------------------------
MONTHS = (
    "january february march april may june july august september october november december"
).split()
MONTH_ABBREVIATIONS = [m[:3] for m in MONTHS]

# --- fixed values: page elements ------------------------------------------------------------------------
BULLET_GLYPHS = "•·▪▫‣⁃"
CAPTION_WORDS = ("figure", "table", "chart", "image")
HEADING_WORDS = ("chapter", "section", "introduction", "conclusion")
ELEMENT_TYPES = {
    "title": "title", "content": "paragraph", "bullet": "bullet", "notes": "notes",
    "heading": "heading", "paragraph": "paragraph", "caption": "caption",
}
PROTECTION_KINDS = (
    "protected_names", "technical_terms", "dates", "numbers", "abbreviations", "ids",
)

# --- fixed values: colours --------------------------------------------------------------------------------
COLOUR_NAMES = {
    "theme:LIGHT_1": "white", "theme:TEXT_1": "dark_gray", "color_type:None": "unknown",
    "#FFFFFF": "white", "#555555": "dark_gray", "#2D86C1": "blue", "#CFDEED": "light_blue",
}
HEX_NAMES = {
    "#FFFFFF": "white", "#FFF": "white", "#555555": "dark_gray", "#555": "dark_gray",
    "#2D86C1": "blue", "#CFDEED": "light_blue",
}
THEME_SLOTS = {
    "ACCENT_1": "accent1", "ACCENT_2": "accent2", "ACCENT_3": "accent3", "ACCENT_4": "accent4",
    "ACCENT_5": "accent5", "ACCENT_6": "accent6", "TEXT_1": "dk1", "TEXT_2": "dk2",
    "BACKGROUND_1": "lt1", "BACKGROUND_2": "lt2",
}

# --- fixed values: file and template names -------------------------------------------------------------------
NAME_FILLERS = ("draft", "final", "v1", "v2", "v3", "copy", "new", "updated")
# (template suffix, keywords), in priority order.
TEMPLATE_KEYWORDS = (
    ("ipr template", ("ipr", "intellectual property", "ip review")),
    ("itr template", ("itr", "technical report", "tech report")),
    ("project overview deck template", ("overview", "project overview", "deck")),
    ("project summary slide template", ("summary", "project summary")),
    ("proposal kick-off meeting template", ("proposal", "kick-off", "kickoff", "kick off")),
    ("standard template", ("standard", "general", "default")),
    ("table template", ("table", "data table", "tables")),
)

# --- fixed values: scoring ---------------------------------------------------------------------------------------
CATEGORY_WEIGHTS = {
    "grammar": 20.0, "tone": 25.0, "usage": 20.0, "word-list": 10.0, "formatting": 15.0, "filename": 10.0,
}
GRADE_BANDS = (
    (90.0, "A", "Excellent"), (80.0, "B", "Good"), (70.0, "C", "Satisfactory"),
    (60.0, "D", "Needs Improvement"),
)

# --- fixed values: analyzer vocabulary -> stored vocabulary --------------------------------------------------------
STORED_SEVERITY = {
    "critical": "critical", "high": "high", "medium": "medium", "low": "low", "info": "info",
    "error": "high", "warning": "medium", "suggestion": "low",
}
STORED_CATEGORY = {
    "grammar": "grammar", "tone": "tone", "tone-issue": "tone", "style": "style",
    "formatting": "formatting", "content": "content", "filename": "style",
}

# --- fixed values: job stages -----------------------------------------------------------------------------------------
STAGE_PERCENT = {
    "uploading": 10, "uploaded": 20, "extracting": 30, "extracted": 50, "analyzing": 60,
    "generating": 80, "finalizing": 90, "completed": 100, "error": 0,
}

# --- our own small default lists, standing in for a part-of-speech tagger and a sentiment model ----------------------------
VERB_WORDS = (
    "am is are was were be been being have has had do does did will would shall should can could may might must "
    "make makes made use uses used need needs needed run runs wait waits go goes see write read show shows"
).split()
NON_NOUN_WORDS = VERB_WORDS + (
    "the a an this that these those i you he she it we they me him her us them my your his its our their "
    "very not never always also just only then"
).split()
SENTIMENT_WEIGHTS = {
    "awful": -2.5, "bad": -2.5, "broken": -1.5, "disgusting": -2.5, "fail": -2.5, "failed": -2.0, "failure": -2.5, "hate": -3.0,
    "horrible": -2.5, "idiot": -2.5, "pathetic": -2.0, "poor": -2.0, "problem": -1.5, "stupid": -2.5, "terrible": -2.5,
    "useless": -2.0, "worst": -3.0, "worthless": -2.0,
    "excellent": 2.5, "good": 2.0, "great": 3.0, "helpful": 2.0, "reliable": 2.0, "strong": 2.0, "success": 2.5,
}
SENTIMENT_ALPHA = 15.0
SENTIMENT_THRESHOLD = -0.40
