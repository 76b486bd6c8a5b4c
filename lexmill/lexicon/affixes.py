"""Affix lists of the shallow segmenter. Order is priority: the first that fits is taken, not the longest."""

# Fixed values.
EN_SUFFIXES = [
    "ational", "tional", "enci", "anci", "izer", "ising", "izing", "alism", "ness",
    "ation", "ator", "alism", "aliti", "ousli", "ousness", "iveness", "fulness",
    "ible", "able", "ment", "ness", "ful", "ous", "ive", "ing", "tion", "ed", "er", "ly", "s",
]
# Fixed values.
AR_PREFIXES = ["ال", "وال", "بال", "كال", "فال", "لل", "وب", "وك", "وف", "وم", "ف", "ب", "ك", "ل", "و"]
AR_SUFFIXES = ["ون", "ين", "ات", "ان", "ها", "هم", "هن", "كم", "كن", "نا", "تم", "تن", "ني", "ه", "ة", "ي", "ا"]
# Fixed values.
TR_SUFFIXES = [
    "ların", "lerin", "ların", "lerin", "ları", "leri", "lar", "ler",
    "nın", "nin", "nun", "nün", "ın", "in", "un", "ün",
    "dan", "den", "tan", "ten", "da", "de", "ta", "te",
    "ya", "ye", "a", "e", "ı", "i", "u", "ü",
    "dır", "dir", "dur", "dür", "tır", "tir", "tur", "tür",
    "mak", "mek", "yor", "iyor", "acak", "ecek", "dı", "di", "du", "dü",
    "mış", "miş", "muş", "müş", "ım", "im", "um", "üm",
    "lık", "lik", "luk", "lük", "cı", "ci", "cu", "cü", "çı", "çi", "çu", "çü",
    "sız", "siz", "suz", "süz", "sal", "sel", "ça", "çe",
]
# Fixed value: characters stripped from both ends of a word before segmentation.
EDGE = ".,!?;:\"'()[]{}—–-"
