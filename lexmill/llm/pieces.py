"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

The encoder is a score-ordered agenda: every adjacent pair of symbols whose join is a piece waits in a heap, the best
score first and the leftmost of equal scores, and joined symbols put their new neighbours on the heap. Characters that
no piece covers fall back to byte pieces. Where no piece has a space mark behind another character, pairs never join
across the beginning of a word, so texts are cut there and each distinct word is encoded once; each word encoded that
way is checked against the sentencepiece library, a batch of Arrow rows at a time. Vocabularies with pieces across
words are encoded as one agenda.

Cases: null counts as an empty text, which has no pieces but the begin and end ids; texts of any length are done whole;
an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE, BREAK = "▁", "\n"
#: Words kept between texts of a worker, and the longest of them; a longer word is encoded each time.
MEMO_WORDS, MEMO_CHARS = 300_000, 64
#: Characters of text worked on together.
GROUP_CHARS = 1 << 17
#: Rank of a pair that no piece joins; id of an empty place.
NONE, VOID, UNCOVERED = np.int32(2**31 - 1), (1 << 20) - 1, -1


def piece_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """A vocabulary read with the sentencepiece library, whose own encoder serves as the check only."""

    def __init__(self, model: bytes, memo_words: int = MEMO_WORDS):
        import sentencepiece

        self.memo_words = memo_words
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = sp.id_to_piece(list(range(n)))
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.score, self.id, self.byte_id = {}, {}, [self.unk] * 256
        self.byte_of, self.hidden = {}, set()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                b = int(p[3:-1], 16)
                self.byte_id[b], self.byte_of[i] = i, b
            elif sp.is_control(i):
                self.hidden.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                self.id[p], self.score[p] = i, sp.get_score(i)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        # A line break that no piece contains is joined with nothing, so texts are cut around it too.
        self.word = WORD if any(BREAK in p for p in self.id) else LINE_WORD
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are already marks."""
        score = self.score
        sym = list(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                joined = sym[a] + sym[b]
                s = score.get(joined)
                if s is not None:
                    heapq.heappush(heap, (-s, a, b, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not sym[a] or not sym[b] or right[a] != b or sym[a] + sym[b] != joined:
                continue  # one of the two has been joined with another since
            sym[a], sym[b] = joined, ""
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for s in sym:
            if s:
                i = self.id.get(s)
                if i is None:
                    out += [self.byte_id[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def _pairs(self) -> None:
        """Every way to join two pieces: sorted codes with the rank (0 is joined first) and the id of the join."""
        got = []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    got.append((a << 20 | b, -self.score[p], i))
        table = np.array(sorted(got), np.float64).reshape(-1, 3)
        self.codes = np.append(table[:, 0].astype(np.int64), np.int64(1) << 60)
        order = np.unique(table[:, 1], return_inverse=True)[1]
        self.ranks = np.append(order.astype(np.int32), NONE).astype(np.int32)
        self.joins = np.append(table[:, 2].astype(np.int32), 0).astype(np.int32)
        # Ids of single characters by code point: NUL fills up rows, a character without a piece is UNCOVERED.
        self.char_ids = np.full(0x110000, UNCOVERED, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.char_ids[0] = VOID

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.codes, code)
        hit = self.codes[at] == code
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.joins[at], 0)

    def agendas(self, words: list[str]) -> list[bytes]:
        """agenda() for many words at once: a row of a matrix is the agenda of one word, and each round joins the best pair of every row."""
        out: list[bytes | None] = [None] * len(words)
        if not hasattr(self, "codes"):
            self._pairs()
        lanes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            if n > 32 or "\0" in w:
                out[k] = np.array(self.agenda(w), "<u4").tobytes()
            else:
                lanes.setdefault(8 if n <= 8 else 12 if n <= 12 else 20 if n <= 20 else 32, []).append(k)
        for width, lane in lanes.items():
            for at in range(0, len(lane), 8192):
                part = lane[at : at + 8192]
                filled = "".join([words[k].ljust(width, "\0") for k in part])
                m = self.char_ids[np.frombuffer(filled.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)]
                covered = (m != UNCOVERED).all(axis=1)
                for i in np.flatnonzero(~covered).tolist():
                    out[part[i]] = np.array(self.agenda(words[part[i]]), "<u4").tobytes()
                some, m = [part[i] for i in np.flatnonzero(covered).tolist()], m[covered]
                if not some:
                    continue
                rank, join = self._look(m[:, :-1], m[:, 1:])
                live = np.arange(len(some))
                cols = np.arange(width)
                while len(live):
                    r = rank[live]
                    j = r.argmin(axis=1)
                    go = r[np.arange(len(live)), j] < NONE
                    live, j = live[go], j[go]
                    if not len(live):
                        break
                    joined = join[live, j]
                    src = np.minimum(cols + (cols > j[:, None]), width - 1)
                    row = np.take_along_axis(m[live], src, axis=1)
                    row[:, -1] = VOID
                    row[np.arange(len(live)), j] = joined
                    m[live] = row
                    src = np.minimum(cols[:-1] + (cols[:-1] > j[:, None]), width - 2)
                    rk, jn = np.take_along_axis(rank[live], src, axis=1), np.take_along_axis(join[live], src, axis=1)
                    rk[:, -1] = NONE
                    for d in (-1, 0):
                        c = np.clip(j + d, 0, width - 2)
                        x, y = self._look(row[np.arange(len(live)), c], row[np.arange(len(live)), c + 1])
                        rk[np.arange(len(live)), c], jn[np.arange(len(live)), c] = x, y
                    rank[live], join[live] = rk, jn
                size = (m != VOID).sum(axis=1)
                flat = m.astype("<u4").tobytes()
                for i, (k, n) in enumerate(zip(some, size.tolist())):
                    out[k] = flat[4 * width * i : 4 * (width * i + n)]
        return out

    def _agree(self, words: list[str], got: list[bytes]) -> bool:
        """Whether the library has the same ids. It puts a mark in front itself: that is the word's own first mark, or else goes with a line break put before the word."""
        some = [k for k, w in enumerate(words) if w != SPACE]  # a lone mark is one piece, where the library sees an empty text
        own = [words[k][0] == SPACE for k in some]
        want = self.library.encode([words[k][1:].replace(SPACE, " ") if o else BREAK + words[k] for k, o in zip(some, own)], num_threads=1)
        want = [x if o else x[2:] for x, o in zip(want, own)]
        flat = np.fromiter(chain.from_iterable(want), "<u4")
        size = np.array([len(x) for x in want], np.int64) * 4
        mine = np.array([len(got[k]) for k in some], np.int64)
        return bool((size == mine).all()) and flat.tobytes() == b"".join([got[k] for k in some])

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, checked against the library."""
        got = self.agendas(words)
        if not self._agree(words, got):
            bad = [w for w, x in zip(words, got) if not self._agree([w], [x])]
            raise ValueError(f"agenda and library differ on {bad[:3]!r}")
        return got

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end of each text, as little-endian unsigned 32-bit integers."""
        first, last = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        if not self.by_word:
            return [first + np.array(self.agenda(SPACE + t.replace(" ", SPACE) if t else ""), "<u4").tobytes() + last for t in texts]
        # Words keep spaces for marks until they are learned: a mark makes each character of a string two bytes wide.
        memo, old, new = self.memo, self.old, []
        parts = [self.word.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        for w in set().union(*parts).difference(memo):
            got = old.get(w)
            if got is None:
                new.append(w)
            else:
                memo[w] = got
        memo.update(zip(new, self.learn([w.replace(" ", SPACE) for w in new])))
        out = [first + b"".join(map(memo.__getitem__, p)) + last for p in parts]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        if len(memo) > self.memo_words // 2:  # words met again are carried over from the older half
            self.old, self.memo = memo, {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes | list[int]) -> str:
        """Text of ids: marks become spaces, the first one goes, runs of byte pieces are read as UTF-8."""
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, "<u4").tolist()
        if not hasattr(self, "_text"):
            self._text = [b"" if i in self.hidden else bytes([self.byte_of[i]]) if i in self.byte_of else b" \xe2\x81\x87 " if i == self.unk else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        skip = len(ids) and ids[0] in self.hidden
        body = b"".join(map(self._text.__getitem__, ids[1:] if skip else ids))
        text = body.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: A run of spaces with what follows up to the next space; the same within lines.
WORD = re.compile(" +[^ ]*")
LINE_WORD = re.compile(" +[^ \n]*|[^ \n]+|\n")


_SHARED: dict[tuple[bytes, int], Pieces] = {}


def shared_pieces(model: bytes, memo_words: int = MEMO_WORDS) -> Pieces:
    """One vocabulary and memo for all tasks of a Python worker."""
    key = hashlib.sha256(model).digest(), memo_words
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Pieces(model, memo_words)
    return _SHARED[key]


def encode_decode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """id_col, ids binary (little-endian unsigned 32-bit, with begin and end), decoded string.

    Texts are decoded by the library, whose decode() the one of Pieces equals. with_ids=False leaves the ids out where only the decoded text is wanted. Raises if a word's ids differ from the
    library's. The model is a few hundred kilobytes of bytes in the task's closure. memo_words changes no result: a worker
    that keeps fewer words takes less memory and encodes more of them again.
    """
    src = common.ids_and_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        pieces, out = shared_pieces(model, memo_words), None
        for batch in batches:
            if out is None:
                out = common.Out(pa.schema([("_id", batch.schema.field(0).type), ("ids", pa.binary()), ("decoded", pa.string())]))
            for group in common.groups(batch, GROUP_CHARS):
                coded = pieces.encode_batch([t for _, t in group])
                for (key, _), ids, decoded in zip(group, coded, pieces.library.decode([np.frombuffer(x, "<u4").tolist() for x in coded], num_threads=1)):
                    out.add((key, ids if with_ids else None, decoded), len(ids) + 2 * len(decoded))
                    if out.full():
                        yield out.take()
        if out is not None and out.cols[0]:
            yield out.take()

    return src.mapInArrow(common.tidy(run), f"_id {kind}, ids binary, decoded string").withColumnRenamed("_id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    x = encode_decode(common.documents(spark, sf_dir), piece_model(model_path or tokenizer_path()))
    return x.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
