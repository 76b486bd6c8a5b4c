"""Nominal suffixes of Turkish."""

# Surface forms with what they mark.
PLURAL = {"lar": "PL", "ler": "PL"}
POSSESSIVE = {
    "ım": "1SG", "im": "1SG", "um": "1SG", "üm": "1SG",
    "ın": "2SG", "in": "2SG", "un": "2SG", "ün": "2SG",
    "sı": "3SG", "si": "3SG", "su": "3SG", "sü": "3SG",
    "ımız": "1PL", "imiz": "1PL", "umuz": "1PL", "ümüz": "1PL",
    "mız": "1PL", "miz": "1PL", "muz": "1PL", "müz": "1PL",
    "ınız": "2PL", "iniz": "2PL", "unuz": "2PL", "ünüz": "2PL",
    "nız": "2PL", "niz": "2PL", "nuz": "2PL", "nüz": "2PL",
    "ları": "3PL", "leri": "3PL",
}
CASE = {
    "ı": "ACC", "i": "ACC", "u": "ACC", "ü": "ACC", "yı": "ACC", "yi": "ACC", "yu": "ACC", "yü": "ACC",
    "a": "DAT", "e": "DAT", "ya": "DAT", "ye": "DAT", "da": "LOC", "de": "LOC", "ta": "LOC", "te": "LOC",
    "dan": "ABL", "den": "ABL", "tan": "ABL", "ten": "ABL", "ın": "GEN", "in": "GEN", "un": "GEN", "ün": "GEN",
    "nın": "GEN", "nin": "GEN", "nun": "GEN", "nün": "GEN", "la": "INS", "le": "INS", "yla": "INS", "yle": "INS",
    "na": "DAT", "ne": "DAT", "nda": "LOC", "nde": "LOC", "ndan": "ABL", "nden": "ABL",
    "nı": "ACC", "ni": "ACC", "nu": "ACC", "nü": "ACC",
}
# A bare vowel that marks the third person before a case with n.
IMPLIED_3SG = ["ı", "i", "u", "ü"]
# Stems whose last y, n or s is their own.
OWN_LAST = ["köy", "kuy", "kuyu", "yay", "ay", "boy", "bay", "say", "tay", "soy", "toy", "yıl", "han", "ton", "son"]
VOWELS, BACK, ROUNDED, HIGH = "aıoueiöü", "aıou", "oöuü", "ıiuü"
# Last consonants before a vowel, and what they were.
HARDENED = {"b": "p", "c": "ç", "d": "t", "ğ": "k", "g": "k"}
