"""Sentence rules for English over the tokens of a sentence.

A token is struct<surface, pos, tags>; tags are key=value joined by |. Disambiguation reads the left neighbour as already
rewritten, so a sentence is gone through word by word; guards read the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import english as L

TOKEN = "struct<surface:string,pos:string,tags:string>"

_DETERMINERS, _SUBJECTS, _PRONOUNS, _BASES, _COUNTS = map(frozenset, (L.DETERMINERS, L.SUBJECTS, L.PRONOUNS, L.VERB_BASES, L.COUNTS))
_BE, _HAVE, _AUX = frozenset(L.BE), frozenset(L.HAVE), frozenset(L.BE + L.HAVE + L.DO + L.MODALS)
_SUBORDINATORS, _COORDINATORS = frozenset(L.SUBORDINATORS), frozenset(L.COORDINATORS)
#: Words that a rule names.
_NAMED = frozenset("runs running to that this these those before after more less".split())
_LETTERS = {"DET": "d", "ADJ": "a", "NOUN": "n", "PRON": "p", "UNKNOWN": "u", "PREP": "i", "VERB": "v"}
_DIGITS, _MARKS = re.compile("[0-9]+"), re.compile("[.!?;,]+")
_BAD_DET, _BAD_PREP, _SUBJECT_LETTER = re.compile("da*($|[^anpu])"), re.compile("i[da]*($|[^danp])"), re.compile("[npdu]")


@lru_cache(maxsize=1 << 12)
def _kv(tags: str) -> frozenset[str]:
    return frozenset(tags.split("|"))


class Token:
    """A word with what rules ask about it; made once for each surface and analysis."""

    __slots__ = ("surface", "low", "pos", "tags", "label", "kv", "letter", "ruled", "verbal", "aux", "content", "np_verb")

    def __init__(self, surface: str, low: str, pos: str, tags: str):
        self.surface, self.low, self.pos, self.tags = surface, low, pos, tags
        self.label = f"{pos}:{tags}" if tags else pos
        self.kv = _kv(tags)
        self.letter = _LETTERS.get(pos, "x")
        self.aux = pos == "AUX" or low in _AUX
        self.verbal = pos == "VERB" or self.aux
        self.content = pos not in ("FOREIGN", "PUNCT") and not (surface[-1:] in ".!?;," and _MARKS.fullmatch(surface))
        #: A verb that is a noun behind a determiner.
        self.np_verb = pos == "VERB" and not low.endswith("ing") and "aspect=PROG" not in self.kv
        self.ruled = low in _NAMED or self.np_verb or (pos == "NOUN" and low.endswith("er"))


token = lru_cache(maxsize=1 << 16)(Token)


def _rewritten(t: Token, p: Token | None, nx: list[Token]) -> Token:
    """t behind p, which is rewritten already, and before nx, which are not."""
    new = lambda pos, tags="": token(t.surface, t.low, pos, tags)
    s, n1, n2 = t.low, nx[0] if nx else None, nx[1] if len(nx) > 1 else None
    after_det = p is not None and (p.low in _DETERMINERS or p.pos in ("DET", "ADJ") or "poss=YES" in p.kv)
    # Words whose own rule applies are done with it.
    if s == "runs":
        if after_det or (p is not None and (_DIGITS.fullmatch(p.low) or p.low in _COUNTS)):
            return new("NOUN", "num=PL")
        if p is not None and (p.low in _SUBJECTS or p.pos in ("NOUN", "PRON")):
            return new("VERB", "person=3SG|tense=PRES")
    elif s == "running":
        if p is not None and (p.low in _BE or p.low in ("keep", "kept", "keeps", "keeping")):
            return new("VERB", "aspect=PROG|tense=PRES")
        if p is None and n1 is not None and n1.pos in ("VERB", "AUX"):
            return new("NOUN")
    elif s == "to" and n1 is not None:
        if n1.low in _BASES or n1.pos == "VERB":
            return new("PART", "subcat=INF")
        if n1.low in _DETERMINERS or n1.low in _PRONOUNS or n1.pos in ("NOUN", "PRON", "DET"):
            return new("PREP")
    elif s == "that":
        if p is not None and p.pos == "VERB":
            return new("CONJ", "subcat=COMP")
        if n1 is not None and n1.pos in ("NOUN", "UNKNOWN", "ADJ"):
            return new("DET")
    # The others go through the general rules one after another.
    if s in ("this", "these", "those"):
        t = new("DET") if n1 is not None and n1.pos in ("NOUN", "ADJ", "UNKNOWN") else new("PRON", t.tags)
    elif s in ("before", "after") and n1 is not None:
        if n1.low in _SUBJECTS or (n1.pos in ("NOUN", "PRON") and n2 is not None and n2.pos == "VERB"):
            t = new("CONJ", "subcat=SUB")
        elif n1.low in _DETERMINERS or n1.low in _PRONOUNS or n1.pos in ("NOUN", "PRON", "DET", "ADJ"):
            t = new("PREP")
    if t.np_verb and after_det:
        t = new("NOUN")
    if s in ("more", "less") and ((n1 is not None and n1.pos in ("ADJ", "ADV")) or any(n.low == "than" for n in nx)):
        return new("ADV", "degree=COMP")
    if t.pos == "NOUN" and s.endswith("er") and n1 is not None and n1.low == "than":
        return new("ADJ", "degree=COMP")
    return t


def resolve(tokens: list[Token]) -> list[Token]:
    """The tokens of a sentence with ambiguous words resolved by their neighbours."""
    out: list[Token] = []
    for i, t in enumerate(tokens):
        out.append(_rewritten(t, out[-1] if out else None, tokens[i + 1 : i + 4]) if t.ruled else t)
    return out


def verdict(tokens: list[Token]) -> str:
    """'ok' or the name of the first guard that a sentence's content words fail."""
    if not tokens:
        return "ok"
    if not any(t.verbal for t in tokens):
        return "no main verb or copula"
    subs = [i for i, t in enumerate(tokens) if t.pos == "CONJ" and t.low in _SUBORDINATORS or "subcat=SUB" in t.kv]
    if subs:
        tail = tokens[subs[-1] + 1 :]
        if not (any(t.pos in ("NOUN", "PRON", "UNKNOWN", "DET") or t.low in _SUBJECTS for t in tail) and any(t.verbal for t in tail)):
            return "subordinator without clause"
    # What a class of words is followed by, as a string of classes: one letter a word.
    letters = "".join([t.letter for t in tokens])
    if _BAD_DET.search(letters):
        return "determiner without noun"
    if _BAD_PREP.search(letters):
        return "preposition without object"
    if any("aspect=PROG" in t.kv for t in tokens) and not any(t.low in _BE for t in tokens):
        return "aspect without auxiliary"
    if any("aspect=PERF" in t.kv and t.low.endswith(("en", "ed")) for t in tokens) and not any(t.low in _HAVE for t in tokens):
        return "aspect without auxiliary"
    first, last = tokens[0], tokens[-1]
    if (first.pos == "CONJ" and first.low in _COORDINATORS and "subcat=SUB" not in first.kv) or (last.pos == "CONJ" and last.low in _COORDINATORS):
        return "coordinator at an edge"
    verb = letters.find("v")
    if verb >= 0:
        noun = _SUBJECT_LETTER.search(letters)
        found = [noun.start()] if noun else []
        found += [i for i, t in enumerate(tokens) if t.low in _SUBJECTS][:1]
        if not found:
            return "missing subject"
        if min(found) > verb:
            return "subject after verb"
    return "ok"


@dataclass
class Lines:
    """Words of many lines: each is a place in a list of distinct tokens. A line begins where the one before ends; the last number of starts is the end of all."""

    tokens: list[Token]
    codes: np.ndarray
    starts: np.ndarray

    def of(self, values: list) -> list[list]:
        """Each line's words as the values of their tokens."""
        flat, ends = np.array([*values, None], object)[self.codes].tolist(), self.starts.tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


def resolve_lines(lines: Lines) -> Lines:
    """resolve() for many lines: only words that a rule can change are visited, from the left."""
    tokens, codes = list(lines.tokens), lines.codes.copy()
    at = np.flatnonzero(np.array([t.ruled for t in tokens], bool)[codes])
    line = np.searchsorted(lines.starts, at, side="right") - 1
    place = {id(t): k for k, t in enumerate(tokens)}
    now = codes.tolist()
    for i, a, b in zip(at.tolist(), lines.starts[line].tolist(), lines.starts[line + 1].tolist()):
        t = tokens[now[i]]
        new = _rewritten(t, tokens[now[i - 1]] if i > a else None, [tokens[k] for k in now[i + 1 : min(i + 4, b)]])
        if new is not t:
            k = place.get(id(new))
            if k is None:
                k = place[id(new)] = len(tokens)
                tokens.append(new)  # kept here, so no other token gets its id
            now[i] = k
    return Lines(tokens, np.array(now, np.int64), lines.starts)


#: What guards ask about a word, one bit each.
_FLAGS = (
    lambda t: t.verbal,
    lambda t: t.pos == "CONJ" and t.low in _SUBORDINATORS or "subcat=SUB" in t.kv,
    lambda t: t.pos in ("NOUN", "PRON", "UNKNOWN", "DET") or t.low in _SUBJECTS,
    lambda t: "aspect=PROG" in t.kv,
    lambda t: t.low in _BE,
    lambda t: "aspect=PERF" in t.kv and t.low.endswith(("en", "ed")),
    lambda t: t.low in _HAVE,
    lambda t: t.pos == "CONJ" and t.low in _COORDINATORS and "subcat=SUB" not in t.kv,
    lambda t: t.pos == "CONJ" and t.low in _COORDINATORS,
    lambda t: t.low in _SUBJECTS,
)


def verdicts(lines: Lines) -> list[str]:
    """verdict() of the content words of each of many lines."""
    n, content = len(lines.starts) - 1, np.array([t.content for t in lines.tokens], bool)[lines.codes]
    row = np.repeat(np.arange(n), np.diff(lines.starts))[content]
    codes = lines.codes[content]
    verbal, sub, nominal, prog, be, perf, have, opens, closes, subject = (np.array([flag(t) for t in lines.tokens], bool)[codes] for flag in _FLAGS)
    letter = np.frombuffer("".join([t.letter for t in lines.tokens]).encode(), np.uint8)[codes]
    is_in = lambda letters: np.isin(letter, np.frombuffer(letters, np.uint8))
    size = len(codes)

    def some(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) > 0

    def first(mask: np.ndarray) -> np.ndarray:
        out, at = np.full(n, size), np.flatnonzero(mask)
        np.minimum.at(out, row[at], at)
        return out

    def followed(by: int, over: bytes, good: bytes) -> np.ndarray:
        """Whether a line has the letter by that, past all letters of over, neither ends nor is before one of good."""
        at, stop = np.flatnonzero(letter == by), np.append(np.flatnonzero(~is_in(over)), size)
        # a line's end stops too: the next letter that counts is in another line
        to = stop[np.searchsorted(stop, at, side="right")]
        inside = np.minimum(to, max(size - 1, 0))
        bad = (to == size) | (row[inside] != row[at]) | ~is_in(good)[inside]
        out = np.zeros(n, bool)
        out[row[at[bad]]] = True
        return out

    last_sub = np.full(n, -1)
    np.maximum.at(last_sub, row[sub], np.flatnonzero(sub))
    tail = (last_sub[row] >= 0) & (np.arange(size) > last_sub[row])
    at = np.flatnonzero(np.diff(row, prepend=-1))
    edge = np.zeros(n, bool)
    edge[row[at]] = opens[at]
    at = np.flatnonzero(np.diff(row, append=n))
    edge[row[at]] |= closes[at]
    verb, noun = first(letter == ord("v")), np.minimum(first(is_in(b"npdu")), first(subject))
    guards = {
        "ok": np.bincount(row, minlength=n) == 0,
        "no main verb or copula": ~some(verbal),
        "subordinator without clause": (last_sub >= 0) & ~(some(tail & nominal) & some(tail & verbal)),
        "determiner without noun": followed(ord("d"), b"a", b"npu"),
        "preposition without object": followed(ord("i"), b"da", b"np"),
        "aspect without auxiliary": (some(prog) & ~some(be)) | (some(perf) & ~some(have)),
        "coordinator at an edge": edge,
        "missing subject": (verb < size) & (noun == size),
        "subject after verb": (verb < size) & (noun > verb),
    }
    names = [*guards, "ok"]
    return [names[k] for k in np.append(np.stack([*guards.values()]), np.ones((1, n), bool), axis=0).argmax(axis=0).tolist()]


def _tokens(rows) -> list[Token]:
    return [token(r["surface"], r["surface"].lower(), r["pos"], r["tags"]) for r in rows]


def disambiguate(tokens: Column) -> Column:
    """array<token> with ambiguous words resolved by their neighbours."""
    return F.udf(lambda rows: None if rows is None else [(t.surface, t.pos, t.tags) for t in resolve(_tokens(rows))], f"array<{TOKEN}>")(tokens)


def content(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t["pos"].isin("FOREIGN", "PUNCT") & ~t["surface"].rlike("^[.!?;,]+$"))


def validate(tokens: Column) -> Column:
    """'ok' or the name of the first guard that fails, for a sentence's content words."""
    return F.udf(lambda rows: None if rows is None else verdict(_tokens(rows)), "string")(tokens)
