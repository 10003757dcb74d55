"""One hit and one miss for each predicate, on hand-made annotations."""

import pytest
from pyspark.sql import functions as F

from doselab.operators import match


def words(*rows):
    """rows: text, upos, lemma, feats, deprel, head."""
    return [(i + 1, r[0], r[2], r[1], None, r[3], r[5], r[4]) for i, r in enumerate(rows)]


def w(text, upos="X", lemma=None, feats=None, deprel="dep", head=0):
    return (text, upos, lemma or text.lower(), feats, deprel, head)


CASES = {
    ("aann", (0, 4)): words(w("a", "DET", head=4), w("lovely", "ADJ", head=4), w("three", "NUM", head=4), w("days", "NOUN", "day", "Number=Plur")),
    ("aann", None): words(w("a", "DET", head=3), w("lovely", "ADJ", head=3), w("day", "NOUN", "day", "Number=Sing")),
    ("comparative_correlative", (0, 7)): words(w("the", "DET"), w("harder", "ADV", feats="Degree=Cmp"), w("you", "PRON"), w("try", "VERB"), w(",", "PUNCT"), w("the", "DET"), w("better", "ADJ", feats="Degree=Cmp"), w("it", "PRON"), w("gets", "VERB")),
    ("comparative_correlative", None): words(w("she"), w("tried"), w("hard"), w("and"), w("it"), w("got"), w("better", "ADJ", feats="Degree=Cmp")),
    ("tough_movement", (2, 6)): words(w("this"), w("book"), w("is", "AUX", "be"), w("easy", "ADJ"), w("to", "PART"), w("read", "VERB")),
    ("tough_movement", None): words(w("this"), w("book"), w("is", "AUX", "be"), w("eager", "ADJ"), w("to", "PART"), w("please", "VERB")),
    ("resultative", (1, 5)): words(w("he", "PRON", head=2), w("hammered", "VERB"), w("the", "DET", head=4), w("metal", "NOUN", deprel="obj", head=2), w("flat", "ADJ", deprel="xcomp", head=2)),
    ("resultative", None): words(w("he", "PRON", head=2), w("hammered", "VERB"), w("the", "DET", head=4), w("metal", "NOUN", deprel="obj", head=2)),
    ("existential_there", (0, 3)): words(w("there", "PRON", deprel="expl", head=2), w("are", "VERB", "be"), w("three", "NUM"), w("cats", "NOUN")),
    ("existential_there", None): words(w("put", "VERB"), w("it", "PRON"), w("there", "ADV")),
    ("it_cleft", (0, 5)): words(w("it", "PRON"), w("was", "AUX", "be"), w("the", "DET"), w("dog", "NOUN"), w("that", "PRON"), w("barked", "VERB")),
    ("it_cleft", None): words(w("was", "AUX", "be"), w("it", "PRON"), w("the", "DET"), w("dog", "NOUN"), w("that", "PRON"), w("barked", "VERB")),
    ("negative_inversion", (0, 3)): words(w("never", "ADV"), w("have", "AUX"), w("I", "PRON", deprel="nsubj"), w("seen", "VERB")),
    ("negative_inversion", None): words(w("never", "ADV"), w("I", "PRON", deprel="nsubj"), w("have", "AUX"), w("seen", "VERB")),
    ("subject_to_object_raising", (1, 5)): words(w("they", "PRON"), w("believed", "VERB", "believe"), w("him", "PRON"), w("to", "PART"), w("be", "AUX"), w("guilty", "ADJ")),
    ("subject_to_object_raising", None): words(w("they", "PRON"), w("believed", "VERB", "believe"), w("him", "PRON"), w("be", "AUX"), w("guilty", "ADJ")),
}


def test_all_cases(spark):
    rows = [(k, code, span, " ".join(x[1] for x in ws), ws) for k, ((code, span), ws) in enumerate(CASES.items())]
    table = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], f"k int, text string, words {match.WORDS_TYPE}").unionByName(spark.createDataFrame([(99, "", [])], f"k int, text string, words {match.WORDS_TYPE}")).cache()
    found = {r["k"]: r for r in match.match_all(table).collect()}
    for k, code, span, *_ in rows:
        m = found[k][code]
        assert m["matched"] == (span is not None), (code, m)
        assert (m["start"], m["end"]) == (span or (None, None)), (code, m)
    assert not any(found[99][c]["matched"] for c in match.REGISTRY)
    hits = match.positives(table).groupBy("construction").agg(F.count("*").alias("n")).collect()
    assert {r["construction"] for r in hits} == set(match.REGISTRY)


def test_unknown_code():
    with pytest.raises(KeyError, match="aann"):
        match.get_predicate("nope")
