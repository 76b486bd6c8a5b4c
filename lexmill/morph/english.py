"""English words taken apart: one inflection, then prefixes and suffixes one after another down to the deepest real word.

Each distinct word is a row. A step looks at a row's form, makes the forms that one affix less would leave, and looks them up
in the lexicon of known words by one join; rows that end leave the loop, the others go on, each step written. The row
remembers the last form that was a real word, and goes back to it if the peeling ends in a fragment.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..lexicon import english_words as E

#: Steps at most.
STEPS = 12


@dataclass(frozen=True)
class Lexicon:
    """Further words: irregular forms with base, part of speech and tags, and compounds with their parts. Both are closed classes that a person lists, so they go into the expressions."""

    irregular: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    compounds: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"bookshop": ("book", "shop")})

    def forms(self) -> dict[str, tuple[str, str, str]]:
        return self.irregular | {k: (base, "ADJ", f"degree={d}") for k, (base, d) in E.DEGREES.items()}

    def bases(self) -> list[str]:
        """Words at which the peeling stops."""
        forms = self.forms()
        return sorted({*E.VERBS, *E.ADJECTIVES, *E.NOUNS, *E.RESTORED.values(), *(f[0] for f in forms.values()), *forms, *self.compounds})


def by_length(affixes) -> list[str]:
    return sorted(affixes, key=lambda a: -len(a))


PREFIXES, SUFFIXES = by_length(E.PREFIX_GLOSS), by_length(E.SUFFIX_POS)
CLOSED = {w: p for p, ws in E.CLOSED.items() for w in ws}
FALLBACK = {w: p for p, ws in E.FALLBACK.items() for w in ws}
#: Words that are no root of another: too common to be one by chance.
NO_ROOTS = [*CLOSED, *(w for w, p in FALLBACK.items() if p != "ADJ")]


def pick(c: Column, table: dict[str, str]) -> Column:
    """The value of a fixed table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def cut(c: Column, n: int) -> Column:
    """c without its last n characters."""
    return F.substr(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def plus(c: Column, s: str) -> Column:
    return F.concat(c, F.lit(s))


class Rules:
    """Column expressions over one lexicon. `real` is an array of those forms of the row that the known words have."""

    def __init__(self, lexicon: Lexicon):
        self.forms, self.compounds, self.bases = lexicon.forms(), lexicon.compounds, lexicon.bases()
        self._literals: dict[str, Column] = {}

    def literals(self, words) -> list[Column]:
        """Words as columns, each made once: the driver asks the JVM for every one."""
        words = list(words)
        for w in words:
            if w not in self._literals:
                self._literals[w] = F.lit(w)
        return [self._literals[w] for w in words]

    def known_base(self, c: Column) -> Column:
        return c.isin(self.literals(self.bases))

    def real(self, c: Column) -> Column:
        return F.array_contains(F.col("real"), c) | self.known_base(c)

    def verb(self, c: Column) -> Column:
        """A common verb or an irregular form."""
        return c.isin(self.literals(E.VERBS)) | c.isin(self.literals(list(self.forms)))

    def valid(self, c: Column) -> Column:
        """c, or c with a silent e, if that is a real word; else null."""
        return F.when(self.real(c), c).when(self.real(plus(c, "e")), plus(c, "e"))

    def root_like(self, c: Column) -> Column:
        return (F.length(c) >= 3) & ~c.isin(self.literals(NO_ROOTS)) & self.real(c)

    def base_pos(self, c: Column) -> Column:
        out = F.when(c.isin(self.literals(E.VERBS)), "VERB").when(c.isin(self.literals(E.ADJECTIVES)), "ADJ").when(c.isin(self.literals(E.NOUNS)), "NOUN")
        return F.coalesce(out, pick(c, {k: v[1] for k, v in self.forms.items()}), F.lit("UNKNOWN"))

    # inflection

    def with_e(self, stem: Column) -> Column:
        """The stem with the silent e that -ed or -ing took, where it took one."""
        e = plus(stem, "e")
        lost = stem.rlike("[^aeiou][aeiou][^aeiouwyxkhqj]$") & ~stem.isin(self.literals(E.NO_SILENT_E + E.ADJECTIVES + E.NOUNS))
        return F.when(self.verb(e) | e.isin(self.literals(E.ADJECTIVES)), e).when(self.real(e), e).when(self.real(stem), stem).when(lost, e).otherwise(stem)

    @staticmethod
    def inflected_forms(w: Column) -> Column:
        return F.array(w, cut(w, 1), cut(w, 2), plus(cut(w, 2), "e"), cut(w, 3), plus(cut(w, 3), "e"))

    def inflection(self, w: Column) -> Column:
        """struct<stem, tags, pos> if w has an inflectional ending, else null."""
        x = lambda stem, tags, pos: F.struct(stem.alias("stem"), F.lit(tags).alias("tags"), F.lit(pos).alias("pos"))
        n, doubled = F.length(w), lambda s: s.rlike("^.+([^aeiou])\\1$")
        ing, ed, es, s = cut(w, 3), cut(w, 2), cut(w, 2), cut(w, 1)
        est, er = cut(w, 3), cut(w, 2)
        third = ("person=3SG|tense=PRES", "VERB")
        verb_like = plus(es, "e").isin(self.literals(E.VERBS)) | plus(es, "e").isin(self.literals([k for k, v in self.forms.items() if v[1] == "VERB"])) | plus(es, "e").rlike("(" + "|".join(E.VERB_ENDINGS) + ")$")
        adj = lambda c: c.isin(self.literals(E.ADJECTIVES))
        of_ing = F.when(doubled(ing), cut(ing, 1)).otherwise(self.with_e(ing))
        of_ed = F.when(doubled(ed) & ~self.verb(ed), cut(ed, 1)).otherwise(self.with_e(ed))
        of_es = (
            F.when(es.isin(self.literals(E.VERBS)), x(es, *third)).when(self.verb(plus(es, "e")), x(plus(es, "e"), *third))
            .when(~self.real(es) & self.real(plus(es, "e")), F.when(verb_like, x(plus(es, "e"), *third)).otherwise(x(plus(es, "e"), "num=PL", "NOUN")))
            .otherwise(x(es, "num=PL", "NOUN"))
        )
        whole = w.endswith("ous") | w.isin(self.literals(E.NOT_PLURAL)) | (~s.isin(self.literals(E.VERBS)) & self.real(w) & ~self.real(s))
        of_s = F.when(s.isin(self.literals(E.VERBS)), x(s, *third)).otherwise(x(s, "num=PL", "NOUN"))
        return (
            F.when(w.endswith("'s"), x(cut(w, 2), "poss=YES", "POSS"))
            .when(w.endswith("ing") & (n > 5), x(of_ing, "aspect=PROG|tense=PRES", "VERB"))
            .when(w.endswith("ied") & (n > 4), x(plus(cut(w, 3), "y"), "tense=PAST", "VERB"))
            .when(w.endswith("ed") & (n > 3), x(of_ed, "tense=PAST", "VERB"))
            .when(w.endswith("ies") & (n > 3), x(plus(cut(w, 3), "y"), "num=PL", "NOUN"))
            .when(w.endswith("es") & (n > 3), of_es)
            .when(w.endswith("s") & (n > 3) & ~w.endswith("ss"), F.when(~whole, of_s))
            .when(w.endswith("iest") & (n > 5) & adj(plus(cut(w, 4), "y")), x(plus(cut(w, 4), "y"), "degree=SUPER", "ADJ"))
            .when(w.endswith("est") & (n > 5), F.when(adj(est) | est.isin(self.literals(E.VERBS + E.COMPARED_ADVERBS)), x(est, "degree=SUPER", "ADJ")).when(adj(plus(est, "e")), x(plus(est, "e"), "degree=SUPER", "ADJ")))
            .when(w.endswith("ier") & (n > 4) & adj(plus(cut(w, 3), "y")), x(plus(cut(w, 3), "y"), "degree=COMP", "ADJ"))
            .when(w.endswith("er") & (n > 4), F.when(adj(er), x(er, "degree=COMP", "ADJ")).when(adj(plus(er, "e")), x(plus(er, "e"), "degree=COMP", "ADJ")).when(er.isin(self.literals(E.COMPARED_ADVERBS)), x(er, "degree=COMP", "ADV")))
        )

    # one affix

    @staticmethod
    def prefix(c: Column) -> Column:
        """The longest listed prefix that leaves three letters, or null."""
        out = F.when(c.isin(E.NO_PREFIX), F.lit(None).cast("string"))
        for p in PREFIXES:
            out = out.when(c.startswith(p) & (F.length(c) >= len(p) + 3), p)
        return out

    def suffixes(self, c: Column) -> Column:
        """All suffixes that c can have, the longest first."""
        own = F.array(*map(F.lit, [s for s in SUFFIXES if s != "ee"]))
        stem = lambda s: F.substr(c, F.lit(1), F.greatest(F.length(c) - F.length(s), F.lit(0)))
        fits = lambda s: F.endswith(c, s) & (F.length(c) - F.length(s) >= F.when(s.isin("able", "ible"), 2).otherwise(3)) & ((s != "like") | stem(s).isin(self.literals(E.NOUNS + self.bases_only())))
        return F.when(c.isin(self.literals(E.NO_SUFFIX + E.NO_MENT)), F.array().cast("array<string>")).otherwise(F.filter(own, fits))

    def bases_only(self) -> list[str]:
        forms = self.forms
        return sorted({*E.VERBS, *E.ADJECTIVES, *E.NOUNS, *E.RESTORED.values(), *(f[0] for f in forms.values())})

    def forms_to_ask(self) -> Column:
        """All forms of cur that a step asks the lexicon for."""
        cur, rem = F.col("cur"), F.expr("substr(cur, length(pre) + 1)")
        stems = F.transform("sufs", lambda s: F.substr(cur, F.lit(1), F.length(cur) - F.length(s)))
        made = F.flatten(F.transform(stems, lambda n: F.array(n, plus(n, "e"), plus(n, "y"), plus(n, "le"), cut(n, 2))))
        return F.array_distinct(F.filter(F.concat(F.array(cur), F.when(F.col("pre").isNotNull(), F.array(rem, plus(rem, "e"))).otherwise(F.array().cast("array<string>")), made), lambda x: F.length(x) > 0))

    def agent(self, c: Column) -> tuple[Column, Column]:
        """What an agent in -er, -or or -ar does, or null; and the ending."""
        base, e = cut(c, 2), plus(cut(c, 2), "e")
        found = F.when(~base.isin(self.literals(E.ADJECTIVES)), F.when(self.verb(e), e).when(self.verb(base) | base.isin(self.literals(E.NOUNS)), base).when(c.isin(self.literals(E.AGENTS)), F.when(e.isin(self.literals(E.ADJECTIVES + E.NOUNS)), e).otherwise(base)))
        return F.when(c.rlike("^.{3,}[eoa]r$"), found), F.right(c, F.lit(2))

    def restored(self, n: Column, s: Column) -> Column:
        """The word that a stem comes from, by the suffix that it lost."""
        e, ate, le = plus(n, "e"), plus(n, "ate"), plus(n, "le")
        verb_e = F.when(self.verb(e), e).otherwise(n)
        common = lambda c: c.isin(self.literals(E.VERBS))
        out = (
            F.when(s.isin("tion", "ation", "ition"), F.when(self.verb(ate), ate).otherwise(verb_e))
            .when(s == "sion", F.when(common(plus(n, "de")), plus(n, "de")).when(common(e), e).otherwise(n))
            .when(s.isin("ment", "able", "ible", "ative", "itive", "ive"), verb_e)
            .when(s == "ity", F.when(n.endswith("il"), plus(cut(n, 2), "le")).when(e.isin(self.literals(E.ADJECTIVES)) | common(e), e).otherwise(n))
            .when(s.isin("ify", "fy") & ~self.real(n), F.when(self.real(plus(n, "y")), plus(n, "y")).when(self.real(e), e).otherwise(n))
            .when(s == "ly", F.when((n.endswith("ab") | n.endswith("ib")) & self.real(le), le).when(n.endswith("i"), plus(cut(n, 1), "y")).when(le.isin(self.literals(E.ADJECTIVES)), le).when(n.rlike("[^aeiou]l$"), e).otherwise(n))
            .when(s == "ist", F.when(e.isin(self.literals(E.NOUNS)), e).otherwise(n))
            .otherwise(n)
        )
        out = F.coalesce(pick(n, E.RESTORED), out)
        return F.when((out == n) & s.isin(self.literals(E.E_ELIDING)) & ~self.real(n) & self.real(e), e).otherwise(out)

    # one step

    def step(self, rows: DataFrame) -> DataFrame:
        """rows (w, cur, chain, pos, best, best_len, best_pos, pre, sufs, real) after one more affix; act says what was done."""
        stages, kept, again = self.stages
        for columns in stages:
            rows = rows.withColumns(columns)
        return rows.select(*kept).withColumns(again)

    @cached_property
    def stages(self) -> tuple[list[dict[str, Column]], list[str | Column], dict[str, Column]]:
        """The columns of a step, one group over another, then those that are kept and one over these: the same at each step, and made once."""
        cur, pre, pos, col = F.col("cur"), F.col("pre"), F.col("pos"), F.col
        stages = [{"best_pos": F.when(self.root_like(cur) & ~cur.isin(self.literals(list(E.KEPT))), pos).otherwise(col("best_pos")), "best_len": F.when(self.root_like(cur) & ~cur.isin(self.literals(list(E.KEPT))), F.size("chain")).otherwise(col("best_len")), "best": F.when(self.root_like(cur) & ~cur.isin(self.literals(list(E.KEPT))), cur).otherwise(col("best"))}]
        stages += [{"rem": F.expr("substr(cur, length(pre) + 1)")}, {"remv": F.when(pre.isNotNull(), self.valid(col("rem")))}]
        stem = lambda s: F.substr(cur, F.lit(1), F.length(cur) - F.length(s))
        sure = F.filter("sufs", lambda s: self.valid(stem(s)).isNotNull() | stem(s).isin(self.literals(list(E.RESTORED))))
        stages.append({"suf": F.coalesce(F.try_element_at(sure, F.lit(1)), F.try_element_at("sufs", F.lit(1)))})
        stages.append({"stem": F.expr("substr(cur, 1, length(cur) - length(suf))")})
        stages.append({"res": F.when(col("suf").isNotNull(), self.restored(col("stem"), col("suf")))})
        base, ending = self.agent(cur)
        stages.append({"doer": base, "ending": ending})
        productive = pre.isin(self.literals(E.PRODUCTIVE_PREFIXES))
        irregular_verbs = {k: v[0] for k, v in self.forms.items() if v[1] == "VERB"}
        act = (
            F.when(cur.isin(self.literals(list(E.KEPT))) | self.known_base(cur), "end")
            .when(pre.isNotNull() & col("rem").isin(self.literals(list(irregular_verbs))), "irregular")
            .when(pre.isNotNull() & (self.known_base(col("rem")) | col("rem").isin(self.literals(list(E.RESTORED)))), "base")
            .when(productive & (F.length("remv") >= 4), "word")
            .when(col("doer").isNotNull(), "agent")
            .when(F.length("res") >= 2, "suffix")
            .when(productive & (F.length("remv") >= 3), "free")
            .otherwise("end")
        )
        stages.append({"act": act})
        act, res, suf, chain = col("act"), col("res"), col("suf"), col("chain")
        note = lambda affix, gloss: F.concat(affix, F.lit("→"), gloss)
        prefixed = F.concat(chain, F.array(note(pre, pick(pre, E.PREFIX_GLOSS))))
        suffixed = F.concat(chain, F.array(note(suf, F.coalesce(pick(suf, E.SUFFIX_GLOSS), F.lit("DERIVED")))))
        li = (suf == "ness") & res.endswith("li")
        folded = (suf == "ation") & ~self.real(res) & res.rlike("i[sz]$") & self.real(cut(res, 2))
        deep = (suf == "ation") & ~folded & res.rlike("ali[sz]$")
        verbal = note(F.when(res.endswith("s"), "ise").otherwise("ize"), F.lit("VERBALIZE"))
        more = F.when(li, F.array(F.lit("ly→MANNER"))).when(folded, F.array(verbal)).when(deep, F.array(verbal, F.lit("al→RELATIONAL"))).otherwise(F.array().cast("array<string>"))
        after = F.when(li | folded, cut(res, 2)).when(deep, cut(res, 4)).otherwise(res)
        new_pos = (
            F.when(act == "end", F.coalesce(pos, pick(cur, E.KEPT))).when(act == "irregular", F.coalesce(pos, F.lit("VERB"))).when(act == "base", F.coalesce(pos, self.base_pos(col("rem"))))
            .when(act == "word", F.coalesce(pos, self.base_pos(col("remv")))).when(act == "agent", F.coalesce(pos, F.lit("NOUN"))).when(act == "suffix", F.coalesce(pos, pick(suf, E.SUFFIX_POS))).otherwise(pos)
        )
        new_cur = (
            F.when(act == "irregular", pick(col("rem"), irregular_verbs or {"": ""})).when(act == "base", col("rem")).when(act.isin("word", "free"), col("remv")).when(act == "agent", col("doer")).when(act == "suffix", after).otherwise(cur)
        )
        new_chain = F.when(act.isin("irregular", "base", "word", "free"), prefixed).when(act == "agent", F.concat(chain, F.array(note(col("ending"), F.lit("AGENT_NOUN"))))).when(act == "suffix", F.concat(suffixed, more)).otherwise(chain)
        kept = ["w", "act", "best", "best_len", "best_pos", new_pos.alias("pos"), new_cur.alias("cur"), new_chain.alias("chain")]
        return stages, kept, {"cur": F.coalesce(pick(col("cur"), E.RESTORED), col("cur"))}


def looked_up(rows: DataFrame, known: DataFrame, forms: Column) -> DataFrame:
    """rows with real: those of the forms that are known words. One join on the form, one on the row's word."""
    asked = rows.select("w", F.explode(forms).alias("form"))
    hits = asked.join(known.select(F.col("w").alias("form")), "form", "left_semi").groupBy("w").agg(F.collect_set("form").alias("real"))
    return rows.join(hits, "w", "left").withColumn("real", F.coalesce("real", F.array().cast("array<string>")))


def peel(stems: DataFrame, known: DataFrame, rules: Rules, steps: Steps) -> DataFrame:
    """w, root, chain, pos: each stem's deepest real word, the affixes on the way from the outside in, and the part of speech that they make."""
    w, rem = F.col("w"), F.expr("substr(w, length(pre) + 1)")
    x = stems.select("w").distinct().withColumn("pre", rules.prefix(w))
    x = x.withColumn("twice", rules.known_base(w) & F.col("pre").isNotNull() & rules.known_base(rem) & ~w.isin(list(E.KEPT)))
    first = F.when(F.col("twice"), F.array(F.concat("pre", F.lit("→"), pick(F.col("pre"), E.PREFIX_GLOSS)))).otherwise(F.array().cast("array<string>"))
    cur = F.when(F.col("twice"), rem).otherwise(w)
    cur = F.when(w.isin(list(E.KEPT)), w).otherwise(F.coalesce(pick(cur, E.RESTORED), cur))
    x = x.select("w", cur.alias("cur"), first.alias("chain"), F.when(F.col("twice"), rules.base_pos(rem)).alias("pos"), F.lit("go").alias("act"), F.lit(None).cast("string").alias("best"), F.lit(0).alias("best_len"), F.lit(None).cast("string").alias("best_pos"))
    # the stem itself is the first form to go back to
    x = looked_up(x, known, F.array(w))
    x = x.withColumn("best", F.when(rules.root_like(w), w)).drop("real")
    path, live = steps.write(x)
    ended: list[str] = []
    for n in range(STEPS):
        rows = live.withColumns({"pre": rules.prefix(F.col("cur")), "sufs": rules.suffixes(F.col("cur"))})
        new, done = steps.write(rules.step(looked_up(rows, known, rules.forms_to_ask())))
        steps.drop(path)
        path = new
        ended.append(path)
        live = done.where("act <> 'end'") if n + 1 < STEPS else done.limit(0)
        if live.isEmpty():
            break
        path, live = steps.write(live)
    out = stems.sparkSession.read.schema(done.schema).parquet(*ended)
    if len(ended) < STEPS:
        out = out.where("act = 'end'")
    else:
        last = stems.sparkSession.read.schema(done.schema).parquet(ended[-1])
        out = out.where("act = 'end'").unionByName(last.where("act <> 'end'"))
    out = looked_up(out, known, F.array("cur", "w"))
    bad, cur = ~rules.root_like(F.col("cur")), F.col("cur")
    back, whole = bad & F.col("best").isNotNull(), bad & F.col("best").isNull() & ~rules.real(cur) & (cur != F.col("w"))
    return out.select(
        "w",
        F.when(back, F.col("best")).when(whole, F.col("w")).otherwise(cur).alias("root"),
        F.when(back, F.slice("chain", 1, F.col("best_len"))).when(whole, F.array().cast("array<string>")).otherwise(F.col("chain")).alias("chain"),
        F.when(back, F.coalesce("pos", "best_pos")).otherwise(F.col("pos")).alias("pos"),
    )


def analyze(words: DataFrame, known: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """w, root, pos, tags (k=v joined by |), chain (joined by +) of each distinct word of the column w; known: a table of real words.

    Null and empty words are left out; case is dropped. Words are asked in this order: foreign words, closed classes, prefixes
    with a hyphen, compounds, irregular forms, inflection with derivation of its stem, derivation, common words by class, words
    with a digit, then letters only as nouns.
    """
    steps = Steps(words.sparkSession, "english")
    rules, w, t = Rules(lexicon), F.col("w"), F.col("t")
    x = words.select(F.lower("w").alias("w")).where("w <> ''").distinct()
    parts = F.split(w, "-")
    hyphen = (F.size(parts) == 2) & parts[0].isin(list(E.PREFIX_GLOSS)) & ~w.isin(E.LOANS)
    x = x.select("w", F.when(hyphen, parts[1]).otherwise(w).alias("t"), F.when(hyphen, F.array(F.concat(parts[0], F.lit("→"), pick(parts[0], E.PREFIX_GLOSS)))).otherwise(F.array().cast("array<string>")).alias("outer"))
    heads = {k: v[-1] for k, v in lexicon.compounds.items()}
    notes = {k: f"COMPOUND({'+'.join(v)})" for k, v in lexicon.compounds.items()}
    if heads:
        x = x.select("w", F.coalesce(pick(t, heads), t).alias("t"), F.when(t.isin(list(heads)), F.concat("outer", F.array(pick(t, notes)))).otherwise(F.col("outer")).alias("outer"))
    fixed = t.isin(E.LOANS) | t.isin(list(CLOSED)) | t.contains("-") | t.isin(list(rules.forms)) | (t == "")
    _, x = steps.write(x.withColumn("fixed", fixed))
    targets = x.where("not fixed").select(F.col("t").alias("w")).distinct()
    inflected = looked_up(targets, known, rules.inflected_forms(w)).select("w", rules.inflection(w).alias("i"))
    _, inflected = steps.write(inflected.select("w", F.coalesce("i.stem", "w").alias("stem"), "i.tags", F.col("i.pos").alias("ipos")))
    need = inflected.where("ipos is null or ipos <> 'POSS'").select(F.col("stem").alias("w"))
    _, peeled = steps.write(peel(need, known, rules, steps))
    y = inflected.join(peeled.withColumnRenamed("w", "stem"), "stem", "left").withColumnRenamed("w", "t")
    none = F.array().cast("array<string>")
    no_chain = F.size(F.coalesce("chain", none)) == 0
    silent = no_chain & F.col("ipos").isNull() & (F.col("root") != t)
    al = silent & (F.concat("root", F.lit("al")) == t)
    ial = silent & (F.concat("root", F.lit("ial")) == t)
    derived = F.col("ipos").isNull() & (~no_chain | (F.col("root") != t) | F.col("pos").isNotNull())
    plain = (
        F.when(t.isin(E.VERBS), "VERB").when(t.isin(E.ADJECTIVES), "ADJ").otherwise(F.coalesce(pick(t, FALLBACK), F.when(t.rlike("\\p{Nd}"), "NUM").when(t.rlike("^\\p{L}+$"), "NOUN").otherwise("UNKNOWN")))
    )
    y = y.select(
        "t",
        F.when(F.col("ipos") == "POSS", F.col("stem")).when(F.col("ipos").isNotNull(), F.when(no_chain, F.col("stem")).otherwise(F.col("root"))).when(derived, F.col("root")).otherwise(t).alias("root"),
        F.when(F.col("ipos") == "POSS", "NOUN").when(F.col("ipos").isNotNull(), F.col("ipos")).when(al | ial, "ADJ").when(derived, F.coalesce("pos", F.lit("UNKNOWN"))).otherwise(plain).alias("pos"),
        F.coalesce("tags", F.lit("")).alias("tags"),
        F.when(F.col("ipos") == "POSS", none).when(al, F.array(F.lit("al→RELATIONAL"))).when(ial, F.array(F.lit("ial→RELATIONAL"))).otherwise(F.coalesce("chain", none)).alias("chain"),
    )
    open_ = x.where("not fixed").join(y, "t").select("w", "root", "pos", "tags", F.concat("outer", "chain").alias("chain"))
    closed_pos = F.when(t.isin(E.LOANS), "UNKNOWN").otherwise(F.coalesce(pick(t, CLOSED), F.when(t.contains("-") | (t == ""), "UNKNOWN"), pick(t, {k: v[1] for k, v in rules.forms.items()})))
    own = ~t.isin(E.LOANS) & ~t.isin(list(CLOSED)) & t.isin(list(rules.forms))
    shut = x.where("fixed").select("w", F.when(own, pick(t, {k: v[0] for k, v in rules.forms.items()})).otherwise(t).alias("root"), closed_pos.alias("pos"), F.when(own, pick(t, {k: v[2] for k, v in rules.forms.items()})).when(t.isin(E.CLOSED["AUX"]) & ~t.isin(E.LOANS), "modal=YES").otherwise("").alias("tags"), F.col("outer").alias("chain"))
    _, out = steps.write(open_.unionByName(shut).withColumn("chain", F.array_join("chain", "+")))
    return out
