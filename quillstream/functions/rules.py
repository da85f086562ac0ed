"""Fixed values of the segmentation rules: words and expressions, limits and costs."""

# Words that no line should end with.
DANGLING = [
    "a", "an", "and", "as", "at", "because", "but", "by", "for", "from", "he's", "i'm", "if", "in", "into", "it's", "its", "my", "of", "on", "or", "our", "she's", "than",
    "that's", "the", "their", "there's", "they're", "to", "we're", "what's", "when", "while", "with", "you're", "your",
]
# Words that need what follows them, besides these.
DEPENDENT = [*DANGLING, "although", "before", "despite", "during", "except", "since", "unless", "until", "whereas"]
# Words that finish the verb before them.
PARTICLES = ["away", "back", "down", "off", "out", "through", "up"]
# Expressions that stay on one line.
EXPRESSIONS = [
    "a lot of", "according to", "as well as", "because of", "but also", "due to", "each other", "in front of", "in terms of", "instead of", "kind of", "more and more",
    "not only", "one of", "out of", "sort of", "such as",
]
# Countries that may stand behind a place and a comma.
COUNTRIES = [
    "america", "australia", "brazil", "britain", "canada", "china", "france", "germany", "india", "italy", "japan", "korea", "mexico", "russia", "singapore", "spain", "thailand", "uk", "usa",
]
# Marks that end a sentence and a clause, and English words as they are counted.
TERMINAL, CLAUSE = "[?!.。！？]", "[,，、;；:：]"
ENGLISH_WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?"
# Characters of a line at most (English, else), and the shortest time of a cue in milliseconds.
ENGLISH_LIMIT, OTHER_LIMIT, SHORTEST = 42, 18, 700
