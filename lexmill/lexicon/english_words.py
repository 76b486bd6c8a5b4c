"""Word classes, affixes and restored forms of the English word analysis."""

# Words with a class of their own, asked first.
CLOSED = {
    "DET": [
        "the", "a", "an",
    ],
    "PREP": [
        "to", "of", "in", "at", "by", "for", "with", "on", "from", "about", "into", "through", "during", "before", "after", "above", "below",
        "between", "under", "over", "against", "along", "among", "around", "behind", "beneath", "beside", "beyond", "despite", "except", "inside",
        "outside", "toward", "towards", "until", "within", "without",
    ],
    "PRON": [
        "i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "we", "us", "our", "ours", "they",
        "them", "their", "theirs", "who", "whom", "whose", "which", "that", "what", "this", "these", "those", "myself", "yourself", "himself",
        "herself", "itself", "ourselves", "yourselves", "themselves",
    ],
    "CONJ": [
        "and", "but", "or", "nor", "so", "yet", "although", "because", "since", "unless", "while", "if", "when", "where", "as", "though", "whereas",
        "whether",
    ],
    "AUX": [
        "can", "could", "will", "would", "shall", "should", "may", "might", "must", "ought", "need", "dare",
    ],
}
# Words that get a class only if no affix explains them.
FALLBACK = {
    "AUX": [
        "be", "been", "being", "have", "having", "do", "doing",
    ],
    "PART": [
        "not", "n't", "no",
    ],
    "ADV": [
        "also", "often", "very", "too", "then", "thus", "now", "here", "there", "again", "never", "perhaps", "however", "therefore", "just", "even",
        "still", "already", "soon", "almost", "quite", "rather", "indeed", "instead", "hence", "otherwise", "meanwhile", "together", "later",
        "earlier", "moreover", "furthermore", "nonetheless", "nevertheless",
    ],
    "DET": [
        "some", "any", "all", "each", "every", "another", "both", "either", "neither", "much",
    ],
    "ADJ": [
        "such", "other", "many", "several", "few", "various", "certain", "same", "own", "main", "whole", "entire", "former", "latter", "free",
        "different", "similar", "common", "single", "able",
    ],
    "NUM": [
        "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
        "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
        "thousand", "million", "billion", "trillion",
    ],
}
# Common verbs.
VERBS = [
    "run", "walk", "eat", "play", "talk", "work", "move", "look", "think", "know", "want", "need", "feel", "seem", "come", "go", "take", "make",
    "give", "find", "tell", "ask", "use", "try", "leave", "call", "keep", "let", "begin", "show", "hear", "turn", "start", "stand", "lose", "pay",
    "meet", "bring", "hold", "write", "sit", "speak", "read", "grow", "lead", "live", "believe", "happen", "provide", "include", "continue", "set",
    "learn", "change", "follow", "stop", "create", "open", "fall", "win", "offer", "remember", "love", "consider", "appear", "buy", "wait", "serve",
    "die", "send", "expect", "build", "stay", "cut", "reach", "remain", "suggest", "raise", "pass", "sell", "require", "report", "decide", "pull",
    "develop", "break", "receive", "agree", "support", "hit", "produce", "cover", "catch", "draw", "choose", "sing", "swim", "drink", "drive",
    "ride", "fly", "fight", "wear", "throw", "teach", "cost", "help", "like", "mean", "add", "watch", "wash", "paint", "dance", "bake", "evaluate",
    "operate", "exist", "lock", "judge", "connect", "view", "act", "form", "estimate", "load", "mine", "see", "able", "power", "code", "activate",
    "establish", "communicate", "achieve", "improve", "state", "govern", "carry", "marry", "study", "explain", "invite", "educate", "perform",
    "succeed", "tire", "excite", "bore", "interest",
]
# Adjectives.
ADJECTIVES = [
    "tall", "short", "fast", "slow", "old", "young", "new", "smart", "happy", "sad", "big", "small", "long", "wide", "narrow", "deep", "shallow",
    "high", "low", "loud", "quiet", "bright", "dark", "hot", "cold", "warm", "cool", "soft", "hard", "strong", "weak", "rich", "poor", "kind",
    "nice", "rude", "fair", "great", "late", "early", "fine", "safe", "near", "far", "thick", "thin", "clean", "dirty", "full", "empty", "sweet",
    "sour", "round", "square", "smooth", "rough", "tight", "loose", "heavy", "light", "easy", "quick", "true", "false", "real", "fake", "calm",
    "wild", "bold", "shy", "wise", "dumb", "brave", "proud", "humble", "good", "bad", "lonely", "common", "rare", "sharp", "dull", "fresh", "stale",
    "fond", "keen", "neat", "odd", "even", "deaf", "blind", "lame", "sane", "vain", "dear", "aware", "simple", "able", "equal", "active", "possible",
    "legal", "regular", "fiction", "large", "social", "war", "circle", "media", "store", "night", "marine", "human", "power", "lead", "load", "mine",
    "see", "code", "view", "school", "lock", "agree", "like", "judge",
]
# Nouns.
NOUNS = [
    "law", "art", "music", "child", "brother", "friend", "leader", "guitar", "violin", "science", "dent", "danger", "fame", "nation", "social",
    "capital", "real", "terror", "hope", "care", "fool", "media", "store", "night", "circle", "marine", "human", "war", "fiction", "profit", "code",
    "power", "load", "mine", "view", "school", "lock", "establish", "thing", "search", "structure", "god", "agree", "operate", "evaluate", "exist",
    "shop", "book", "board", "light", "room", "sun", "class",
]
# Agent nouns.
AGENTS = [
    "writer", "teacher", "painter", "baker", "singer", "driver", "dancer", "runner", "swimmer", "speaker", "reader", "lawyer", "worker", "player",
    "farmer", "fighter", "builder", "leader", "owner", "buyer", "seller", "manager", "designer", "researcher", "developer",
]
# Adverbs that take -er.
COMPARED_ADVERBS = [
    "soon", "fast", "hard", "long", "near", "late", "early", "high", "low",
]
# Foreign words, kept as they are.
LOANS = [
    "deja", "vu", "schadenfreude", "cliche", "fiance", "fiancee", "rendezvous", "bonjour", "ciao",
]
# Derivational suffixes with the part of speech that they make; of equal length the earlier one is asked first.
SUFFIX_POS = {
    "ness": "NOUN", "ment": "NOUN", "ity": "NOUN", "tion": "NOUN", "sion": "NOUN", "ation": "NOUN", "ition": "NOUN", "ance": "NOUN", "ence": "NOUN",
    "ancy": "NOUN", "ency": "NOUN", "hood": "NOUN", "ship": "NOUN", "dom": "NOUN", "ism": "NOUN", "ist": "NOUN", "arian": "NOUN", "ure": "NOUN",
    "ture": "NOUN", "ee": "NOUN", "eer": "NOUN", "ery": "NOUN", "ling": "NOUN", "let": "NOUN", "ette": "NOUN", "ster": "NOUN", "scape": "NOUN",
    "ize": "VERB", "ise": "VERB", "ify": "VERB", "fy": "VERB", "able": "ADJ", "ible": "ADJ", "ful": "ADJ", "less": "ADJ", "ous": "ADJ", "ish": "ADJ",
    "ive": "ADJ", "ative": "ADJ", "itive": "ADJ", "al": "ADJ", "ial": "ADJ", "ual": "ADJ", "ic": "ADJ", "ical": "ADJ", "ary": "ADJ", "ory": "ADJ",
    "ant": "ADJ", "ent": "ADJ", "like": "ADJ", "some": "ADJ", "wide": "ADJ", "proof": "ADJ", "ward": "ADJ", "wards": "ADJ", "ly": "ADV",
    "wise": "ADV", "fold": "ADV",
}
# What suffixes mean, where there is a name for it.
SUFFIX_GLOSS = {
    "ness": "STATE_QUALITY", "ment": "RESULT_PROCESS", "ity": "STATE_QUALITY", "tion": "ACTION_NOUN", "sion": "ACTION_NOUN", "ation": "ACTION_NOUN",
    "ition": "ACTION_NOUN", "ance": "STATE_PROCESS", "ence": "STATE_PROCESS", "hood": "STATE_PERIOD", "ship": "STATE_ROLE", "dom": "DOMAIN_STATE",
    "ism": "DOCTRINE", "ist": "ADHERENT", "arian": "ADHERENT", "ure": "RESULT_STATE", "ture": "RESULT_STATE", "ee": "PATIENT",
    "eer": "AGENT_OCCUPATION", "ery": "PLACE_COLLECTIVE", "ling": "DIMINUTIVE", "ize": "VERBALIZE", "ise": "VERBALIZE", "ify": "VERBALIZE",
    "fy": "VERBALIZE", "able": "CAPABLE_OF", "ible": "CAPABLE_OF", "ful": "FULL_OF", "less": "WITHOUT", "ous": "HAVING_QUALITY",
    "ish": "APPROXIMATIVE", "ive": "TENDING_TO", "ative": "TENDING_TO", "al": "RELATIONAL", "ial": "RELATIONAL", "ual": "RELATIONAL",
    "ic": "PERTAINING_TO", "ical": "PERTAINING_TO", "ary": "RELATING_TO", "ory": "RELATING_TO", "ant": "ACTIVE_PARTICIPANT",
    "ent": "ACTIVE_PARTICIPANT", "like": "RESEMBLING", "some": "CHARACTERIZED_BY", "wide": "EXTENDING_THROUGH", "proof": "RESISTANT_TO",
    "ward": "DIRECTIONAL", "wards": "DIRECTIONAL", "ly": "MANNER", "wise": "MANNER_RESPECT", "fold": "MULTIPLICATIVE", "er": "AGENT_NOUN",
    "or": "AGENT_NOUN", "ar": "AGENT_NOUN",
}
# Prefixes and what they mean; of equal length the earlier one is asked first.
PREFIX_GLOSS = {
    "un": "NEGATION", "re": "REPETITION", "pre": "BEFORE", "post": "AFTER", "mis": "WRONGLY", "over": "EXCESS", "under": "INSUFFICIENCY",
    "dis": "NEGATION", "non": "NEGATION", "anti": "OPPOSITION", "inter": "BETWEEN", "trans": "ACROSS", "sub": "UNDER_BELOW", "super": "ABOVE_BEYOND",
    "co": "TOGETHER", "counter": "AGAINST", "de": "REVERSAL", "en": "CAUSATIVE", "em": "CAUSATIVE", "fore": "BEFORE_FRONT", "out": "SURPASS",
    "in": "NEGATION", "im": "NEGATION", "il": "NEGATION", "ir": "NEGATION", "mid": "MIDDLE", "semi": "HALF", "multi": "MANY", "mono": "SINGLE",
    "micro": "SMALL", "macro": "LARGE", "neo": "NEW", "pseudo": "FALSE", "auto": "SELF", "bio": "LIFE", "cyber": "DIGITAL", "hyper": "EXCESSIVE",
    "mega": "LARGE",
}
# Suffixes that take a silent e away.
E_ELIDING = [
    "ist", "ism", "ity", "ive", "ative", "itive", "ize", "ise", "ify", "ure", "ture", "ation", "able", "ible",
]
# Prefixes that stand before free words.
PRODUCTIVE_PREFIXES = [
    "un", "re", "dis", "mis", "non", "anti", "over", "under", "pre", "post", "counter", "inter", "trans", "sub", "super", "de", "co", "fore", "out",
    "semi", "multi", "mono", "micro", "macro", "neo", "pseudo", "auto", "bio", "cyber", "hyper", "mega", "mid",
]
# Stems and the words that they come from.
RESTORED = {
    "educ": "educate", "cre": "create", "decid": "decide", "explan": "explain", "explanat": "explain", "invit": "invite", "determin": "determine",
    "creat": "create", "educat": "educate", "decis": "decide", "deci": "decide", "competit": "compete", "compet": "compete", "develop": "develop",
    "achieve": "achieve", "govern": "govern", "improve": "improve", "state": "state", "develo": "develop", "achiev": "achieve", "improv": "improve",
    "stat": "state", "abil": "able", "possibil": "possible", "activ": "active", "real": "real", "equal": "equal", "modern": "modern",
    "organ": "organ", "central": "central", "national": "nation", "nationali": "nation", "nationalis": "nation", "nationaliz": "nation",
    "art": "art", "guitar": "guitar", "violin": "violin", "scient": "science", "dent": "dent", "capital": "capital", "social": "social",
    "terror": "terror", "read": "read", "wash": "wash", "break": "break", "flex": "flex", "us": "use", "breakable_x": "break", "danger": "danger",
    "fam": "fame", "famou": "fame", "dangerou": "danger", "nat": "nation", "music": "music", "child": "child", "brother": "brother",
    "friend": "friend", "leader": "leader", "happi": "happy", "simpl": "simple", "communic": "communicate", "communicat": "communicate",
    "determination_base": "determine", "lawy": "law", "mus": "music", "godli": "god", "structur": "structure", "termin": "determine",
    "establ": "establish",
}
# Words whose last s is no ending.
NOT_PLURAL = [
    "this", "us", "is", "was", "has", "his", "yes", "as", "gas", "bus", "minus",
]
# Words whose ment is no suffix.
NO_MENT = [
    "experiment", "comment", "document", "instrument", "segment", "garment", "cement", "moment", "torment", "fragment", "pigment", "ornament",
    "ferment", "regiment",
]
# Words whose beginning is no prefix.
NO_PREFIX = [
    "refer", "prefer", "defer", "infer", "confer", "transfer", "commit", "submit", "permit", "admit", "omit", "transmit", "occur", "concur", "incur",
    "recur", "worship", "kidnap", "handicap", "equip", "acquit", "begin", "forget", "regret", "depart", "demand", "depend", "deposit", "comment",
    "instrument",
]
# Stems that never lost an e.
NO_SILENT_E = [
    "open", "happen", "listen", "fasten", "broaden", "deepen", "lighten", "darken", "loosen", "harden", "ripen", "soften", "sharpen", "shorten",
    "strengthen", "frighten", "tighten", "widen",
]
# Endings of verbs.
VERB_ENDINGS = [
    "ize", "ise", "ate", "ify", "ose", "ute", "ude", "olve", "erve", "quire", "scribe", "duce", "ume", "clude", "pose", "move", "prove",
]
# Words whose ending is no suffix.
NO_SUFFIX = [
    "see", "foresee", "agree", "disagree", "tree", "free", "three", "knee", "bee", "fee", "flee", "like", "dislike", "alike", "individual", "secure",
]
# Words that are their own lemma, with their part of speech.
KEPT = {
    "individual": "ADJ", "revolutionary": "ADJ", "various": "ADJ", "ideal": "ADJ", "classical": "ADJ", "contemporary": "ADJ", "significant": "ADJ",
    "philosophical": "ADJ", "political": "ADJ", "ordinary": "ADJ", "primary": "ADJ", "secondary": "ADJ", "military": "ADJ", "literary": "ADJ",
    "necessary": "ADJ", "temporary": "ADJ", "voluntary": "ADJ", "solar": "ADJ", "socialist": "ADJ", "sentence": "NOUN", "experience": "NOUN",
    "audience": "NOUN", "evidence": "NOUN", "difference": "NOUN", "conference": "NOUN", "influence": "NOUN", "consequence": "NOUN", "tactic": "NOUN",
    "tendency": "NOUN", "principle": "NOUN", "authority": "NOUN", "current": "NOUN", "boundary": "NOUN", "category": "NOUN", "territory": "NOUN",
    "memory": "NOUN", "theory": "NOUN", "factory": "NOUN", "victory": "NOUN", "history": "NOUN", "industry": "NOUN", "century": "NOUN",
    "research": "NOUN", "understand": "VERB", "important": "ADJ", "information": "NOUN", "represent": "VERB", "become": "VERB", "interest": "NOUN",
    "between": "ADP", "behavior": "NOUN", "behaviour": "NOUN", "increase": "VERB", "release": "VERB", "instead": "ADV", "report": "NOUN",
    "remain": "VERB", "nature": "NOUN", "moral": "ADJ", "ethics": "NOUN", "ethic": "NOUN", "consensus": "NOUN", "describe": "VERB",
    "federation": "NOUN", "global": "ADJ", "syndicate": "NOUN", "spanish": "ADJ", "federal": "ADJ", "reaction": "NOUN", "overlap": "NOUN",
    "overthrow": "NOUN", "resolution": "NOUN", "resolve": "VERB", "replacement": "NOUN", "reformation": "NOUN", "reform": "NOUN",
    "regardless": "ADV", "return": "VERB", "restore": "VERB", "repress": "VERB", "define": "VERB", "decrease": "VERB", "defence": "NOUN",
    "defeat": "VERB", "declare": "VERB", "dismiss": "VERB", "discussion": "NOUN", "disorder": "NOUN", "display": "VERB", "distribute": "VERB",
    "preserve": "VERB", "precursor": "NOUN", "predatory": "ADJ", "impose": "VERB", "inspire": "VERB", "entire": "ADJ", "internet": "NOUN",
    "transparent": "ADJ", "antiquity": "NOUN", "autonomous": "ADJ", "cooperation": "NOUN", "unprecedented": "ADJ", "mention": "VERB",
    "imply": "VERB",
}
# Irregular forms of degree, with their base. Further irregular forms come as a table.
DEGREES = {
    "better": ("good", "COMP"), "best": ("good", "SUPER"), "worse": ("bad", "COMP"), "worst": ("bad", "SUPER"),
    "more": ("much", "COMP"), "most": ("much", "SUPER"), "less": ("little", "COMP"), "least": ("little", "SUPER"),
}
