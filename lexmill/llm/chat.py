"""Chat formatting by rendering: a template is a black box from a list of turns to a text.

Successive prefixes of a conversation are rendered and each output is compared with the one before. What is new is the turn's
span; where an output does not begin with the one before, the template rewrites history, and the row says from where. Two
renderings with probe texts in the turn's place show what of its span is frame and what is text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that steer a model, and so may stand in a formatted text only where the template puts them.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")


@dataclass(frozen=True)
class InstTemplate:
    """Users within [INST], a system's text within <<SYS>>, answers up to </s>, other roles by name. In texts and names a backslash is doubled, and one is put after the first character of each control string: unescape() undoes both."""

    control: tuple[str, ...] = CONTROL
    _held: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        longest_first = sorted(self.control, key=len, reverse=True)
        object.__setattr__(self, "_held", re.compile(r"\\|" + "|".join(map(re.escape, longest_first))))

    def escape(self, text: str) -> str:
        return self._held.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, role: str, text: str) -> str:
        body = self.escape(text)
        if role == "user":
            return f"[INST] {body} [/INST]"
        if role == "system":
            return f"<<SYS>>\n{body}\n<</SYS>>\n\n"
        if role == "assistant":
            return f" {body}</s>"
        return f"[ROLE]{self.escape(role)}[/ROLE] {body}</s>"

    def __call__(self, turns: list[Turn]) -> str:
        return "<s>" + "".join(self.turn(*t) for t in turns)

    def read(self, piece: str) -> Turn:
        """Role and text of one turn's span, after the <s> that opens a conversation."""
        m = _TURN.fullmatch(piece)
        if m is None:
            raise ValueError("not one turn of this template")
        if m["user"] is not None:
            return "user", self.unescape(m["user"])
        if m["system"] is not None:
            return "system", self.unescape(m["system"])
        if m["role"] is not None:
            return self.unescape(m["role"]), self.unescape(m["other"])
        return "assistant", self.unescape(m["answer"])


_TURN = re.compile(r"(?:<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?)</s>| (?P<answer>.*?)</s>)", re.S)


@dataclass(frozen=True)
class ChatSpec:
    """loss: roles whose texts a model learns. turns, chars: a longer prefix gives way to one that begins two turns back, where the template shows itself append-only and the same from there."""

    loss: frozenset[str] = frozenset({"assistant"})
    turns: int = 16
    chars: int = 1 << 16


def rewrites_history(template: Template, turns: int = 24) -> bool:
    """Whether some rendering of made-up turns does not begin with that of the turns before."""
    roles = ["system", "user", "assistant", "user", "assistant", "assistant"]
    for shift in (0, 1):
        talk = [(roles[(i + shift) % len(roles)] if i + shift < len(roles) else ("user", "assistant")[i % 2], f"text {i}") for i in range(turns)]
        last = ""
        for k in range(1, turns + 1):
            now = template(talk[:k])
            if not now.startswith(last):
                return True
            last = now
    return False


@dataclass
class Piece:
    """One turn: what its rendering adds after the first `keep` characters of the output before; text at [begin, end) of the whole output, or nowhere where the frame cannot be told."""

    keep: int
    piece: str
    rewrites: bool
    begin: int | None
    end: int | None


class Renderer:
    """Follows one conversation turn by turn. Offsets are of the whole output; `base` is what lies before the held window's output."""

    def __init__(self, template: Template, spec: ChatSpec, local: bool):
        self.template, self.spec, self.local = template, spec, local
        self.turns: list[Turn] = []
        self.out, self.base, self.frames = "", 0, {}

    def _frame(self, role: str) -> tuple[str, str] | None:
        """What stands before and after the text of a turn of this role that comes next."""
        a, b = (self.template([*self.turns, (role, x)]) for x in ("x", "y"))
        if not (a.startswith(self.out) and b.startswith(self.out)):
            head = commonprefix([a, b])
            return (head, a[len(head) + 1 :]) if a[len(head) : len(head) + 1] == "x" else None
        a, b = a[len(self.out) :], b[len(self.out) :]
        head = commonprefix([a, b])
        return (head, a[len(head) + 1 :]) if a[len(head) :].startswith("x") and b[len(head) :] == "y" + a[len(head) + 1 :] else None

    def add(self, role: str, text: str) -> Piece:
        self._shorten()
        before = self.out
        now = self.template([*self.turns, (role, text)])
        rewrites = not now.startswith(before)
        keep = len(commonprefix([now, before])) if rewrites else len(before)
        piece = now[keep:]
        key = (role, self.turns[-1][0] if self.turns else None, len(self.turns) < 2)
        frame = self.frames.get(key)
        fits = lambda f, p: f is not None and len(p) >= len(f[0]) + len(f[1]) and p.startswith(f[0]) and p.endswith(f[1])
        whole = now if rewrites else piece
        if rewrites or not fits(frame, whole):
            frame = self._frame(role)
            if not rewrites:
                self.frames[key] = frame
        begin = end = None
        if fits(frame, whole):
            off = self.base + (0 if rewrites else keep)
            begin, end = off + len(frame[0]), off + len(whole) - len(frame[1])
        if rewrites:
            self.local = False
        self.turns.append((role, text))
        self.out = now
        return Piece(self.base + keep, piece, rewrites, begin, end)

    def _shorten(self) -> None:
        """Lets the window begin two turns back, if the last turn's span stays the same from there."""
        if not self.local or len(self.turns) < 3 or (len(self.turns) < self.spec.turns and len(self.out) < self.spec.chars):
            return
        two = self.turns[-2:]
        first, both = self.template(two[:1]), self.template(two)
        added = both[len(first) :] if both.startswith(first) else None
        if added is not None and self.out.endswith(added) and self.template(self.turns[:-1]) + added == self.out:
            self.base += len(self.out) - len(both)
            self.turns, self.out = two, both


TURNS = "conv long, seq long, piece string, keep long, rewrites boolean, begin long, end long, loss boolean"


def ordered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A conversation's rows together and in order of turn, role and text; null turns last. Rows stream from the sort, so a long conversation is never held whole."""
    common.small_batches(conversations.sparkSession)
    c = lambda x: F.col(f"`{x}`")
    x = conversations.select(c(conv_col).cast("long").alias("conv"), c(turn_col).alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    return x.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_last(), "role", "text").select("conv", "role", "text")


def format_turns(conversations: DataFrame, template: Template | None = None, spec: ChatSpec = ChatSpec(), *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, seq (from 0), piece, keep, rewrites, begin, end, loss: a row a turn, in the order of the output.

    A conversation's formatted text is made by taking the first `keep` characters of what there is and adding `piece`, turn
    by turn; with a template that only appends, by joining the pieces. begin and end bound the turn's (escaped) text in it.
    Null texts and roles are empty. Rows without a conversation id are one conversation. Rows that repeat a turn are turns of
    their own. An empty table gives no rows; other columns are not read.
    """
    template = template or InstTemplate()
    local = not rewrites_history(template)
    rows = ordered_turns(conversations, conv_col, turn_col, role_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Out(pa.schema([("conv", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("keep", pa.int64()), ("rewrites", pa.bool_()), ("begin", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]), rows=common.BATCH_ROWS)
        now, at, renderer = object(), 0, None
        for b in batches:
            for i in range(b.num_rows):
                conv, role, text = (b.column(j)[i].as_py() for j in range(3))
                if conv != now:
                    now, at, renderer = conv, 0, Renderer(template, spec, local)
                p = renderer.add(role, text)
                out.add((conv, at, p.piece, p.keep, p.rewrites, p.begin, p.end, role in spec.loss and p.begin is not None), len(p.piece))
                at += 1
                if out.full():
                    yield out.take()
        yield out.take()

    return rows.mapInArrow(common.tidy(run), TURNS)


def read_back(turns: DataFrame, template: InstTemplate) -> DataFrame:
    """A row a conversation, from format_turns' pieces alone, as they stream by in order: digests of the turns read back from the output and of the text under its loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_turns"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out = common.Out(pa.schema(list(zip(names, kinds))))
        now, talk = None, None

        def close() -> None:
            if talk is not None:
                out.add((now, talk["n"], talk["turns"].hexdigest(), talk["chars"], talk["loss"].hexdigest(), talk["size"], talk["rewrites"]), 200)

        for b in batches:
            for i in range(b.num_rows):
                conv, seq, piece, keep, rewrites, begin, end, loss = (b.column(j)[i].as_py() for j in range(8))
                if seq == 0:
                    close()
                    now, talk = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "rewrites": 0}
                    if out.full():
                        yield out.take()
                role, text = template.read(piece)
                talk["n"] += 1
                talk["rewrites"] += rewrites
                talk["turns"].update(f"{role}\n{text}\n".encode())
                if loss:
                    learnt = template.unescape(piece[begin - keep : end - keep])
                    talk["chars"] += len(learnt)
                    talk["loss"].update(learnt.encode())
                talk["size"] = keep + len(piece)
        close()
        yield out.take()

    return turns.mapInArrow(common.tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turns long")


#: Texts that hold the template's own control strings, as conversation -1.
PLANTED = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = common.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    template = InstTemplate()
    return read_back(format_turns(talks.unionByName(planted), template), template)


_MARKED = r"\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]"
OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
x AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_MARKED}')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 19 WHEN 'assistant' THEN 5 ELSE 18 + length(role) + len(regexp_extract_all(role, '{_MARKED}')) END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewritten_turns
FROM x GROUP BY conv_id
"""
