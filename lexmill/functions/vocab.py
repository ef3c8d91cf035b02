"""The word lists, pairs and patterns that the rules' results depend on."""

# Fixed values for concept labels.
RESERVED_VALUES = ["none", "true", "false", "null", "nan", "inf", "infinity"]
COUNTRIES_REGIONS = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Argentina", "Armenia", "Austria", "Azerbaijan",
    "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize", "Benin", "Bhutan", "Bolivia",
    "Bosnia", "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina", "Burma", "Burundi", "Cambodia", "Cameroon",
    "Canada", "Cape", "Central African", "Chad", "Chile", "China", "Colombia", "Comoros", "Congo", "Costa Rica",
    "Croatia", "Cuba", "Cyprus", "Czech", "Denmark", "Djibouti", "Dominica", "Dominican", "Ecuador", "Egypt",
    "El Salvador", "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini", "Ethiopia", "Fiji", "Finland", "France",
    "Gabon", "Gambia", "Georgia", "Germany", "Ghana", "Greece", "Grenada", "Guatemala", "Guinea", "Guinea-Bissau",
    "Guyana", "Haiti", "Honduras", "Hungary", "Iceland", "India", "Indonesia", "Iran", "Iraq", "Ireland", "Israel",
    "Italy", "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati", "Kosovo", "Kuwait", "Kyrgyzstan",
    "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya", "Liechtenstein", "Lithuania", "Luxembourg",
    "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali", "Malta", "Marshall", "Mauritania", "Mauritius",
    "Mexico", "Micronesia", "Moldova", "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Namibia",
    "Nauru", "Nepal", "Netherlands", "New Zealand", "Nicaragua", "Niger", "Nigeria", "North", "Norway", "Oman",
    "Pakistan", "Palau", "Palestine", "Panama", "Papua", "Paraguay", "Peru", "Philippines", "Poland", "Portugal",
    "Qatar", "Republic", "Romania", "Russia", "Rwanda", "Saint", "Samoa", "San Marino", "Sao Tome",
    "Saudi Arabia", "Senegal", "Serbia", "Seychelles", "Sierra Leone", "Singapore", "Slovakia", "Slovenia",
    "Solomon", "Somalia", "South Africa", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden",
    "Switzerland", "Syria", "Taiwan", "Tajikistan", "Tanzania", "Thailand", "Timor", "Togo", "Tonga", "Trinidad",
    "Tunisia", "Turkey", "Turkmenistan", "Tuvalu", "Uganda", "Ukraine", "United Arab", "United Kingdom",
    "United States", "Uruguay", "Uzbekistan", "Vanuatu", "Vatican", "Venezuela", "Vietnam", "Yemen", "Zambia",
    "Zimbabwe",
]
ING_NOUNS = [
    "string", "king", "ring", "thing", "wing", "spring", "morning", "evening", "meeting", "greeting", "warning",
    "meaning", "feeling", "building", "training", "learning", "testing", "boxing", "mining", "dining", "timing",
    "bearing", "hearing", "being", "beginning", "ending",
]
VAGUE_STARTS = ["Example", "Case", "Scenario", "Impact", "Effect", "Overview", "Summary", "Introduction", "Conclusion", "Discussion", "Analysis", "Review", "History"]
IMPERATIVES = [
    "make", "record", "create", "do", "prepare", "write", "provide", "give", "list", "show", "describe", "conduct",
    "submit", "search", "locate", "analyze", "identify", "determine", "find", "calculate", "compute", "apply",
    "solve", "examine", "check", "verify", "state",
]
ADJECTIVES = [
    "higher", "lower", "high", "low", "greater", "lesser", "true", "false", "real", "proper", "correct",
    "incorrect", "good", "bad", "better", "worse", "best", "worst", "large", "small", "larger", "smaller",
    "additional", "extra", "old", "new", "same", "different", "full", "partial", "similar", "common", "general",
    "specific", "typical", "significant", "important", "accurate", "inaccurate",
]
GENERIC_WORDS = ["error", "cost", "value", "other", "information", "data", "result", "output", "input", "process", "item", "thing", "avg", "note", "summary", "description"]
RESOURCE_SUFFIXES = ["website", "portal", "page", "site", "platform", "tool"]
INTERNAL_LABELS = ["canonicalize concept names", "source chunk id", "chunk id", "json array", "existing facts"]

# Fixed values for label normalisation and merging.
GENERIC_SUFFIXES = ["method", "system", "approach", "model", "technique", "process"]
LEADING_FILLERS = ["number of ", "type of ", "kind of "]
MERGE_STOPWORDS = ["a", "an", "the", "of", "in", "for", "to"]
SINGULAR_EXCEPTIONS = [
    "analysis", "basis", "axis", "thesis", "crisis", "diagnosis", "emphasis", "hypothesis", "oasis",
    "parenthesis", "synopsis", "status", "apparatus", "campus", "virus", "census", "bonus", "class", "grass",
    "glass", "mass", "pass", "brass",
]
METRIC_SUFFIXES = ["ratio", "rate", "index", "coefficient"]
TOKEN_STOPWORDS = ["a", "an", "the", "of", "for", "and", "or", "to", "in", "on", "with", "by"]
CONNECTORS = ["of", "in", "and", "or", "to", "for", "on", "with", "by"]
ANTONYMS = [
    ("first", "last"), ("beginning", "ending"), ("gross", "net"), ("increase", "decrease"), ("inflow", "outflow"),
    ("short", "long"), ("direct", "indirect"), ("fixed", "variable"), ("favorable", "unfavorable"),
    ("continue", "discontinue"), ("keep", "replace"), ("make", "buy"), ("lease", "sell"),
]

# Fixed values for fact hygiene and classification.
NOISE_PATTERNS = [
    r"\bthe correct answer is\b", r"\bwhich of the following\b", r"\bmultiple\s*choice\b",
    r"\bchoose\s+(?:one|all|the\s+best)\b", r"\boption\s+[a-d]\b",
    r"\bas\s+explicitly\s+stated\s+in\s+the\s+existing\s+facts\b",
]
TEMPLATE_PATTERNS = [r"\$\.\.\.", r"units at \$", r"\bFigure\s+\d+", r"^\w+\s+was\s+made\s+up\s+of\s+\.\.\."]
NOISE_MARKERS = ["figure", "table", "see page", "as shown", "wave of the future"]
INSTRUCTION_MARKERS = [
    "calculate", "compute", "determine", "find", "assume", "use the following", "indicate the effect", "search",
    "submit", "locate", "prepare", "write", "show that", "demonstrate", "identify", "analyze", "examine", "verify",
    "check", "state", "consider",
]
INSTRUCTION_PHRASES = ["calculate", "provide", "use the following", "compute", "determine", "find", "apply", "solve", "search", "submit", "locate", "prepare", "write"]
INSTRUCTION_STARTS = ["calculate", "compute", "determine", "find", "apply", "use", "solve", "search", "submit", "locate", "prepare", "write"]
#: Lower-case texts one of which is in all that a template pattern or a comparative finds.
TEMPLATE_LITERALS = ["...", "units at $", "figure"]
COMPARATIVE_LITERALS = ["than", "vs", "versus", "compared to", "compared with", "relative to"]
INTERPRETATION_MARKERS = ["means", "indicates", "shows", "suggests", "measures", "implies"]
CAUTION_MARKERS = ["misleading", "manipulate", "risk", "caution", "however", "can be", "may be", "warning"]
EXAMPLE_STRONG = ["resulting from", "requiring an entry", "requires an entry", "remains constant across all scenarios", "independent of the final", "at period end should", "must always equal"]
EXAMPLE_NUMERIC = [
    "had a balance of", "balance of", "amount of", "total amount", "subtracting this ending inventory from",
    "ending inventory value is", "perpetual ending inventory value", "credit entry", "debit entry", "recorded as",
    "was recorded", "before adjustment", "after adjustment", "units at", "dollars at", "units for",
    "resulting in a total", "resulting in the total", "resulting in", "resulted in", "after two sales",
    "there remained", "costing", "cost per unit", "cost each",
]
EXAMPLE_DENSE = ["resulting from", "scenario", "scenarios", "requiring an entry"]
EXAMPLE_MARKERS = ["for example", "e.g.", "scenario", "exercise", "suppose"]
DEFINITION_MARKERS = [" is ", " are ", " refers to ", " is defined as "]
FORMULA_WORDS = ["equation", "formula"]
COMPUTE_CUES = ["divided by", "multiplied by", "plus", "minus", "/", "÷", "×", "*"]

# Fixed values for definition scores and concept types.
DEFINITION_TERMS = ["method", "process", "system", "measure", "ratio", "term", "account"]
STATISTIC_TERMS = ["mean", "median", "variance", "standard deviation", "sample", "dataset", "confidence interval", "p-value", "correlation", "statistic", "ratio"]
TASK_TERMS = ["calculate", "use the following", "assume"]
VAGUE_TERMS = ["key aspect", "important", "various", "etc", "kind of", "type of", "challenge of", "wave of the future"]
COMPARATIVES = [r"\bthan\b", r"\bvs\b", r"\bversus\b", "compared to", "compared with", "relative to"]
RATIO_WORDS = ["ratio", "rate", "turnover", "margin", "index", "coefficient"]
METHOD_WORDS = ["method", "technique", "procedure", "approach", "identification", "allocation"]
SYSTEM_WORDS = ["system", "framework", "model"]
#: (type, [(points, words any of which give them)]); the first type with two points or more counts.
TYPE_SIGNALS = [
    ("ratio", [(1, ["divided by", "multiplied by", "per unit"]), (1, ["measures", "indicates", "higher ratio", "lower ratio"])]),
    ("system", [(2, ["continuously", "periodically", "real-time", "ongoing"]), (1, ["updates", "tracks", "maintains"]), (1, ["at the time of", "at the end of", "as each"])]),
    ("method", [(2, ["method", "technique", "procedure", "approach"]), (1, ["records", "assigns", "allocates", "computes", "estimates"]), (1, ["cost", "value", "price", "amount", "sold"]), (1, ["as if", "based on", "in order of", "oldest", "most recent"])]),
]
SUSPICIOUS_WORDS = ["goals", "impact", "effects"]
