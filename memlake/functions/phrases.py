"""Word lists, patterns and weights that results depend on."""

#: Importance: phrases that raise and lower the score.
HIGH_SIGNAL = [
    "prefer", "always", "never", "important", "remember", "critical",
    "must", "need to", "goal", "decision", "decided", "agreed", "confirmed",
    "password", "api key", "token", "secret", "deadline", "due",
]
LOW_SIGNAL = [
    "thanks", "thank you", "ok", "okay", "sure", "got it", "sounds good",
    "hello", "hi", "hey", "bye", "goodbye", "lol", "haha",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Contradiction: negators and preference words.
NEGATORS = ["not", "don't", "doesn't", "won't", "never", "no longer", "stopped", "switched", "instead"]
PREFERENCES = ["prefer", "like", "use", "love", "want", "need", "hate", "dislike"]

#: Claims: pronouns, filler objects, connectors of compounds (in order of precedence).
PRONOUNS = [
    "i", "me", "my", "mine", "myself",
    "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself",
    "she", "her", "hers", "herself",
    "it", "its", "itself",
    "we", "us", "our", "ours", "ourselves",
    "they", "them", "their", "theirs", "themselves",
    "this", "that", "these", "those",
    "who", "whom", "whose", "which",
    "someone", "somebody", "anyone", "anybody",
    "everyone", "everybody", "no one", "nobody",
]
FILLERS = ["stuff", "things", "something", "various things", "a lot"]
CONNECTORS = [" and ", " but also ", " as well as ", " while also "]

#: Claim confidence: weights of its parts, scores of explicitness.
CONFIDENCE = {"extraction_confidence": 0.25, "entity_resolution_confidence": 0.25, "temporal_resolution_confidence": 0.20, "explicitness": 0.15, "support": 0.10, "source_directness": 0.05}
EXPLICITNESS = {"stated": 1.0, "implied": 0.7, "inferred": 0.4}

#: Questions about time contain one of these.
TEMPORAL = ["current", "now", "today", "latest", "recent"]

#: Patterns of a date beside the months, of amounts (money, share, long number) and of a model's number.
DATE = r"\d{4}-\d{2}-\d{2}"
MONEY, SHARE, LONG_NUMBER = r"\$[\d,]+", r"\d+%", r"\d{4,}"
LEADING_NUMBER = r"^(1\.0|0?\.\d+|\d+\.\d+)"
