"""Structural predicates over a sentence's annotated words.

Each predicate maps (words, text) to struct<matched, start, end, note> with the left-most hit, start and end
0-based and half-open, null on a miss. Four kernels cover them: a contiguous window, a window at the clause's
start, a scan over a gap, and a join of words to their heads. All are Catalyst expressions, so any number of
predicates share one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselab.functions.text import feature

WORDS_TYPE = "array<struct<id:int,text:string,lemma:string,upos:string,xpos:string,feats:string,head:int,deprel:string>>"
#: Lexicons of the predicates.
TOUGH = "tough easy hard difficult simple fun impossible tricky tedious pleasant awkward painful enjoyable boring exciting comfortable uncomfortable convenient inconvenient cheap expensive safe dangerous".split()
RAISING = "believe consider expect find know declare prove suppose assume report".split()
RELATIVIZERS = "that who whom which".split()
INVERSION_PAIRS = ["no sooner", "not only", "not until"]
INVERSION_WORDS = "never rarely seldom hardly scarcely barely nowhere little".split()
AUX_LEMMAS = "be do have will would can could shall should may might must".split()
CORRELATIVE = "(?U)^the\\s+(\\w+er|more|less)\\s+.{1,60}?,\\s*the\\s+(\\w+er|more|less)\\b"

Predicate = Callable[[Column, Column], Column]
Test = Callable[[Column], Column]


def _low(w: Column) -> Column:
    return F.lower(w["text"])


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _hit(start: Column, end: Column, note: str = "") -> Column:
    found = start.isNotNull() & end.isNotNull()
    return F.struct(found.alias("matched"), F.when(found, start).cast("int").alias("start"), F.when(found, end).cast("int").alias("end"), F.lit(note).alias("note"))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value, which is evaluated once however often fn reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _places(words: Column, width: int, test: Callable[[Column], Column]) -> Column:
    """The start indexes at which a window of width words passes."""
    last = F.size(words) - width
    every = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: _true(test(i)))


def _first(places: Column) -> Column:
    return F.get(places, F.lit(0))


def _any_text(words: Column, *values: str) -> Column:
    """Whether a word has one of these forms: one light pass that spares most sentences the windows."""
    return F.exists(words, lambda w: _true(_low(w).isin(*values)))


def _any_lemma(words: Column, values: list[str]) -> Column:
    return _true(F.arrays_overlap(words["lemma"], F.array(*map(F.lit, values))))


def _within(guard: Column, value: Column) -> Column:
    return F.when(guard, value)


def window(words: Column, *tests: Test, also: Callable[[Column], Column] | None = None) -> Column:
    """Kernel 1: the first index from which consecutive words pass the tests in turn."""

    def at(i: Column) -> Column:
        out = F.lit(True)
        for k, test in enumerate(tests):
            out = out & test(F.get(words, i + k))
        return out & also(i) if also else out

    return _first(_places(words, len(tests), at))


def upos(*tags: str) -> Test:
    return lambda w: w["upos"].isin(*tags)


def lemma(*values: str) -> Test:
    return lambda w: w["lemma"].isin(*values)


def form(*values: str) -> Test:
    return lambda w: _low(w).isin(*values)


def both(*tests: Test) -> Test:
    def test(w: Column) -> Column:
        out = tests[0](w)
        for t in tests[1:]:
            out = out & t(w)
        return out

    return test


def either(*tests: Test) -> Test:
    def test(w: Column) -> Column:
        out = tests[0](w)
        for t in tests[1:]:
            out = out | t(w)
        return out

    return test


def is_comparative(w: Column) -> Column:
    graded = (feature(w["feats"], "Degree") == "Cmp") | (F.endswith(_low(w), F.lit("er")) & (F.length(w["text"]) > 3))
    return _true(_low(w).isin("more", "less")) | (_true(w["upos"].isin("ADJ", "ADV")) & _true(graded))


def aann(words: Column, text: Column) -> Column:
    plural: Test = lambda w: (w["upos"] == "NOUN") & (feature(w["feats"], "Number") == "Plur")
    head = lambda i: F.get(words, i)["head"] == F.get(words, i + 3)["id"]
    i = _within(_true(F.array_contains(words["upos"], "NUM")) & _any_text(words, "a", "an"), window(words, both(form("a", "an"), upos("DET")), upos("ADJ"), upos("NUM"), plural, also=head))
    return _let(i, lambda i: _hit(i, i + 4))


def comparative_correlative(words: Column, text: Column) -> Column:
    # Without a comma word there is no pair; the loose form looks at the text alone.
    starts = _within(_true(F.array_contains(words["text"], ",")), _places(words, 2, lambda i: (_low(F.get(words, i)) == "the") & is_comparative(F.get(words, i + 1))))
    loose = _true(F.regexp_like(F.lower(text), F.lit(CORRELATIVE)))

    def span(starts: Column) -> Column:
        one, two = F.get(starts, F.lit(0)), F.get(starts, F.lit(1))
        between = F.exists(F.when(two > one + 2, F.sequence(one + 2, two - 1)), lambda k: F.get(words, k)["text"] == ",")
        paired = _true((one <= 1) & between)
        return _let(F.struct(F.when(paired, one).when(loose, F.lit(0)).alias("s"), F.when(paired, two + 2).when(loose, F.size(words)).alias("e")), lambda x: _hit(x["s"], x["e"]))

    return _let(starts, span)


def tough_movement(words: Column, text: Column) -> Column:
    i = _within(_any_lemma(words, TOUGH) & _any_lemma(words, ["to"]), window(words, lemma("be"), lemma(*TOUGH), lemma("to"), upos("VERB")))
    return _let(i, lambda i: _hit(i, i + 4))


def resultative(words: Column, text: Column) -> Column:
    def parts(v: Column) -> Column:
        child = lambda test: F.get(F.filter(words, lambda w: (w["head"] == v["id"]) & _true(test(w))), F.lit(0))["id"]
        return F.struct(v["id"].alias("v"), child(lambda w: w["deprel"] == "obj").alias("o"), child(lambda w: (w["deprel"] == "xcomp") & (w["upos"] == "ADJ")).alias("x"))

    some = _true(F.array_contains(words["deprel"], "obj")) & _true(F.array_contains(words["deprel"], "xcomp"))
    verbs = _within(some, F.transform(F.filter(words, lambda w: _true(w["upos"] == "VERB")), parts))
    first = F.get(F.filter(verbs, lambda p: p["o"].isNotNull() & p["x"].isNotNull()), F.lit(0))
    return _let(first, lambda f: _hit(F.least(f["v"], f["o"], f["x"]) - 1, F.greatest(f["v"], f["o"], f["x"])))


def existential_there(words: Column, text: Column) -> Column:
    def expletive(i: Column) -> Column:
        w = F.get(words, i)
        return _true(w["deprel"] == "expl") | ((i == 0) & _true(w["upos"].isin("PRON", "DET", "ADV")))

    i = _within(_any_text(words, "there"), window(words, form("there"), lemma("be"), upos("NOUN", "PROPN", "PRON", "NUM", "DET"), also=expletive))
    return _let(i, lambda i: _hit(i, i + 3))


def it_cleft(words: Column, text: Column) -> Column:
    opens = _true(form("it")(F.get(words, F.lit(0))) & upos("PRON")(F.get(words, F.lit(0))) & lemma("be")(F.get(words, F.lit(1))) & (F.size(words) >= 4))
    rest = F.when(F.size(words) > 3, F.sequence(F.lit(3), F.greatest(F.size(words) - 1, F.lit(3))))
    j = F.when(opens, F.get(F.filter(rest, lambda k: _true(form(*RELATIVIZERS)(F.get(words, k)))), F.lit(0)))
    return _let(j, lambda j: _hit(F.when(j.isNotNull(), F.lit(0)), j + 1))


def negative_inversion(words: Column, text: Column) -> Column:
    pair = F.concat_ws(" ", _low(F.get(words, F.lit(0))), _low(F.get(words, F.lit(1))))
    width = F.when(pair.isin(*INVERSION_PAIRS), F.lit(2)).when(_low(F.get(words, F.lit(0))).isin(*INVERSION_WORDS), F.lit(1))
    aux, subject = F.get(words, width), F.get(words, width + 1)
    good = either(upos("AUX"), lemma(*AUX_LEMMAS))(aux) & (_true(subject["deprel"].isin("nsubj", "nsubj:pass")) | _true(subject["upos"].isin("PRON", "PROPN", "NOUN")))
    found = _true(good) & (F.size(words) >= 3) & subject.isNotNull()
    return _let(F.when(found, width), lambda n: _hit(F.when(n.isNotNull(), F.lit(0)), n + 2))


def subject_to_object_raising(words: Column, text: Column) -> Column:
    marker = both(lemma("to"), form("to"))
    verb = upos("VERB", "AUX")
    head = [both(lemma(*RAISING), upos("VERB", "AUX")), upos("PRON", "PROPN", "NOUN", "DET")]

    def at(i: Column) -> Column:
        w = lambda k: F.get(words, i + k)
        near, far = _true(marker(w(2)) & verb(w(3))), _true(marker(w(3)) & verb(w(4)))
        return head[0](w(0)) & head[1](w(1)) & (near | far)

    i = _within(_any_lemma(words, RAISING) & _any_lemma(words, ["to"]), _first(_places(words, 4, at)))

    def span(i: Column) -> Column:
        near = _true(marker(F.get(words, i + 2)) & verb(F.get(words, i + 3)))
        return _hit(i, F.when(near, i + 4).otherwise(i + 5))

    return _let(i, span)


REGISTRY: dict[str, Predicate] = {
    "aann": aann,
    "comparative_correlative": comparative_correlative,
    "tough_movement": tough_movement,
    "resultative": resultative,
    "existential_there": existential_there,
    "it_cleft": it_cleft,
    "negative_inversion": negative_inversion,
    "subject_to_object_raising": subject_to_object_raising,
}


def get_predicate(code: str) -> Predicate:
    if code not in REGISTRY:
        raise KeyError(f"unknown construction {code!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[code]


def match_all(sentences: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """One struct column for each construction, all in one scan."""
    return sentences.select("*", *[get_predicate(c)(F.col("words"), F.col("text")).alias(c) for c in codes or REGISTRY])


def positives(sentences: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """construction and sentence of every hit."""
    codes = codes or list(REGISTRY)
    hits = F.array(*[F.struct(F.lit(c).alias("construction"), get_predicate(c)(F.col("words"), F.col("text")).alias("m")) for c in codes])
    found = sentences.select("*", F.inline(F.filter(hits, lambda h: h["m"]["matched"])))
    return found.select("construction", *[c for c in sentences.columns if c != "words"], "m.start", "m.end")
