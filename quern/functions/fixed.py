"""Fixed values only: word lists, patterns and tables that the evaluation's classes are defined by."""

# Words of an answer that notices a conflict.
CONFLICT_SIGNALS = [
    "contradict", "conflict", "different", "discrepancy", "inconsisten", "mismatch", "changed", "mix-up", "mix up",
    "two versions", "two different", "shifted", "doesn't match", "does not match", "but later", "but then", "however",
    "originally", "initially", "first said", "first time", "while", "whereas", "on the other hand", "knee-high", "waist-high",
]

# Ways to say that one knows nothing of it, and whole answers that say so.
UNAWARE = ["i don't know", "i do not know", "i have no knowledge", "i have no information", "i'm not aware", "i am not aware", "no, i don't", "no, i do not"]
BLANK_ANSWERS = ["i don t know", "i do not know", "unknown", ""]

# The least F1 of a right answer by dimension, and elsewhere.
F1_LIMITS = {"d1_conflict": 0.2, "d2_anaphora": 0.2, "d10_counterfactual": 0.25, "d6_metadata": 0.35, "d7_qa": 0.35}
F1_LIMIT = 0.5

# Answers that only repeat the template.
PLACEHOLDERS = ["<your answer>", "...", "", "your answer here"]

# What a medium is called.
MEDIA = {"face_to_face": "in person", "voice_message": "phone call", "text_message": "text chat"}

# Words that cue secrecy; clitics, negations and irregular forms of the stemmer.
SECRECY_CUES = ["confid", "secret", "private", "opened? up", "quiet", "hush", "between us", "don't tell"]
CLITICS = ["n't", "'s", "'re", "'ve", "'ll", "'d", "'m"]
NEGATIONS = {"can't": "can", "won't": "will", "shan't": "shall"}
IRREGULAR = {
    "sent": "send", "told": "tell", "knew": "know", "known": "know", "felt": "feel", "thought": "think", "kept": "keep", "took": "take",
    "taken": "take", "got": "get", "gotten": "get", "shot": "shoot",
}

# Words that say nothing of a fact, and words that make no hint.
CONTENT_STOP_WORDS = [
    "the", "a", "an", "is", "was", "are", "were", "that", "this",
    "with", "from", "have", "has", "been", "they", "them", "their",
    "about", "just", "also", "would", "could", "should", "really",
    "very", "much", "some", "into", "will", "your", "you", "not",
    "don", "didn", "doesn", "and", "but", "for", "its", "it",
]
HINT_STOP_WORDS = [
    "the", "a", "an", "is", "was", "are", "were", "that", "this",
    "with", "from", "have", "has", "been", "they", "them", "their",
    "about", "just", "also", "would", "could", "should", "really",
    "very", "much", "some", "into", "will", "your", "it's", "you",
    "and", "but", "for", "not", "don't", "didn't", "doesn't",
    "like", "know", "think", "said", "told", "yeah", "okay",
    "it", "i'm", "i'll", "i've", "we're", "he's", "she's",
    "what", "how", "when", "where", "who", "why", "can", "do",
    "did", "does", "got", "get", "going", "went", "come", "came",
    "one", "two", "more", "than", "then", "too", "so", "if",
]
