"""Text functions as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon.affixes import EDGE

#: Marks that end a sentence.
TERMINATORS = ".!?。！？"
# Punctuation at the edges of words, beside that of ASCII; as a class in Java's and RE2's syntax alike.
EDGE_CLASS = "[!-/:-@\\[-`{-~،؛؟…«»“”‘’—–·。！？；：、（）「」]+"
HAN = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"
HEBREW = "[\\x{05D0}-\\x{05EA}]"
ARABIC = "[\\x{0600}-\\x{06FF}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), "\\s+", " "))


def words(c: str | Column) -> Column:
    """Words between white space, in order."""
    return F.regexp_extract_all(col(c), F.lit("\\S+"), F.lit(0))


def clean_line(c: str | Column, least_tokens: int = 5) -> Column:
    """A cleaned line, or '' if it is a header between equals signs, a bare address, or too short."""
    t = collapse(c)
    bad = t.rlike("^=+.*=+$") | t.rlike("^https?://\\S+$") | (F.size(words(t)) < least_tokens)
    return F.when(bad | t.isNull(), F.lit("")).otherwise(t)


def sentences(c: str | Column) -> Column:
    """Cut behind an end mark that white space follows."""
    return F.split(col(c), f"(?<=[{TERMINATORS}])\\s+")


def strip_punct(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"^{EDGE_CLASS}|{EDGE_CLASS}$", "")


def script_class(c: str | Column) -> Column:
    t = col(c)
    return F.when(t.rlike(HAN), "han").when(t.rlike(HEBREW), "hebrew").when(t.rlike(ARABIC), "arabic").when(t.rlike("^[\\x00-\\x7F]*$"), "ascii").otherwise("latin")


def tr_lower(c: str | Column) -> Column:
    """Turkish lower case: the dotted and the dotless capital first."""
    return F.lower(F.translate(col(c), "İI", "iı"))


def strip_diacritics(c: str | Column) -> Column:
    """Short vowels, superscript alef, and ة, go (analysis variant)."""
    return F.regexp_replace(col(c), "[\\x{064B}-\\x{065F}\\x{0670}\\x{0629}]", "")


def strip_diacritics_grammar(c: str | Column) -> Column:
    """Short vowels, superscript alef and tatweel go; ة stays (grammar variant)."""
    return F.regexp_replace(col(c), "[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}]", "")


def hamza_norm(c: str | Column) -> Column:
    return F.translate(col(c), "أإآؤئ", "ءءءءء")


def strip_leading_clitic(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "^[وف](?=.)", "")


def strip_niqqud(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[\\x{0591}-\\x{05AF}\\x{05B0}-\\x{05BD}\\x{05BF}\\x{05C1}\\x{05C2}\\x{05C4}\\x{05C5}\\x{05C7}\\x{05BE}]", "")


def normalize_finals(c: str | Column) -> Column:
    return F.translate(col(c), "ךםןףץ", "כמנפצ")


def root_mask(surface: str | Column, root: str | Column) -> Column:
    """Characters of the surface that the root has become _."""
    return F.array_join(F.transform(F.split(col(surface), ""), lambda ch: F.when((ch != "") & (F.instr(col(root), ch) > 0), "_").otherwise(ch)), "")


def surface_signature(surface: str | Column, root: str | Column) -> Column:
    """The lower-cased surface with the first occurrence of the root as _."""
    s, r = F.lower(col(surface)), F.lower(col(root))
    at = F.locate_col(r, s) if hasattr(F, "locate_col") else F.position(r, s)
    return F.when((F.length(r) > 0) & (at > 0), F.concat(F.substr(s, F.lit(1), at - 1), F.lit("_"), F.substr(s, at + F.length(r)))).otherwise(s)


def feature_bundle(pos: str | Column, tags: str | Column) -> Column:
    """pos=P|k=v|… with sorted keys, or no_features; keys that begin with _ are internal and left out."""
    kept = F.array_sort(F.filter(F.map_entries(col(tags)), lambda e: ~e["key"].startswith("_")))
    pairs = F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat_ws("|", F.concat(F.lit("pos="), col(pos)), F.array_join(pairs, "|"))).otherwise("no_features")


def bundle_parse(bundle: str | Column) -> Column:
    """The tags of a bundle, without pos, as a map."""
    b = col(bundle)
    return F.map_filter(F.str_to_map(b, F.lit("[|]"), F.lit("=")), lambda k, v: (k != "pos") & (b != "no_features"))


def bundle_label(pos: str | Column, tags: str | Column) -> Column:
    """POS[k=v,…] with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_entries(col(tags))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat(col(pos), F.lit("["), F.array_join(pairs, ","), F.lit("]"))).otherwise(col(pos))


def edge_stripped(c: str | Column) -> Column:
    """Lower case without the segmenter's edge marks."""
    return F.btrim(F.lower(col(c)), F.lit(EDGE))
