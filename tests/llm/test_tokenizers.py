"""Byte-level BPE, tokenizer alignment and whitening against plain versions of what they compute."""

import bisect
import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import regex

from doselab.llm import alignment, byte_bpe, whitening

BITS = ["a", "the", "Z", "é", "ß", "1", "42", "'s", "'ll", "!", "-", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "　", "中文", "😀", "_", "<|endoftext|>", "<s>", "<unk>", "<0x41>", ";\r", "\x00", "ﬁ", "½", "٣"]


def odd_texts():
    pick = random.Random(3)
    texts = ["".join(pick.choice(BITS) for _ in range(pick.randint(0, 40))) for _ in range(120)]
    return [*texts, *texts[:5], None, "", " ", "x", " " * 5000, "\n" * 9000 + "a", "x" * 20000, "a▁b", "▁", "ab€😀" * 300 + "😀" * 500, "A few words. " * 20000]


def odd_docs(spark):
    rows = [(None if i % 17 == 0 else i // 2, t, i, "x", "y") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, ids string, segment string").repartition(5)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_bpe(text: str, ranks: dict[bytes, int]) -> list[int]:
    out = []
    for word in regex.findall(public.PATTERN, text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[k] + parts[k + 1] not in ranks:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_byte_bpe_by_the_merge_rule():
    encoder = byte_bpe.multilingual_encoder()
    ranks = encoder._open()._mergeable_ranks
    for text in odd_texts():
        if text and len(text) < 300 and "\x1c" not in text:  # white space to one library's \s only
            assert encoder.encode(text).tolist() == plain_bpe(text, ranks), text


def test_parts_and_runs_change_nothing(monkeypatch):
    encoder = byte_bpe.multilingual_encoder()
    library = encoder._open()
    monkeypatch.setattr(byte_bpe, "RUN", 12)
    monkeypatch.setattr(byte_bpe, "_LONG", re.compile(rf"[{byte_bpe.WHITE}]{{13,}}"))
    pick = random.Random(5)
    for n in range(2000):
        text = "".join(pick.choice(BITS) for _ in range(pick.randint(1, 50)))
        text = text[:9] + pick.choice([" ", "\n", " \n"]) * pick.randint(0, 30) + text[9:]
        parts = list(byte_bpe.parts(text, 3))
        assert "".join(parts) == text
        want = library.encode_ordinary(text)
        assert [i for p in parts for i in library.encode_ordinary(p)] == want
        assert encoder.encode(text).tolist() == want


def test_a_run_that_the_library_alone_can_not_match():
    encoder = byte_bpe.multilingual_encoder()
    text = "\n" * 1_500_000 + "x" * 300_000
    assert encoder.decode(encoder.encode(text)) == text.encode()


def test_byte_bpe_rows(spark):
    encoder = byte_bpe.multilingual_encoder()
    library = encoder._open()
    want = []
    for r in odd_docs(spark).collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, ids, (r.text or "").encode()))
    coded = byte_bpe.encode(odd_docs(spark), encoder)
    assert rows_of(byte_bpe.decode(coded, encoder)) == sorted(want, key=str)
    assert [r.ids for r in byte_bpe.unpack(coded.where("doc_id = 0")).collect()] == [np.frombuffer(i, "<u4").tolist() for d, i, _ in want if d == 0]
    torn = spark.createDataFrame([(1, np.array(encoder.encode("😀")[:1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert [r.decoded for r in byte_bpe.decode(torn, encoder).orderBy("doc_id").collect()] == ["😀".encode()[: len(library.decode_bytes(encoder.encode("😀")[:1].tolist()))], b""]
    assert byte_bpe.decode(byte_bpe.encode(odd_docs(spark).limit(0), encoder), encoder).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert byte_bpe.decode(byte_bpe.encode(broken, encoder), encoder).first().decoded == "a�b".encode()


def plain_alignment(rows):
    """(doc_id, text) to the result, by whole texts."""
    from tokenizers import Tokenizer
    import sentencepiece

    a_side = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printed)))}
    names = {i: t for t, i in json.load(open(public.path("byte_bpe_50k.json")))["model"]["vocab"].items()}

    def piece(i):
        found = re.fullmatch(r"<0x(..)>", b_side.id_to_piece(i))
        return bytes([int(found[1], 16)]) if found else b_side.id_to_piece(i).replace("▁", " ").encode()

    held, count = [], Counter()
    for doc, text in rows:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        own, other = [bytes(byte[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not text or b"".join(own) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
            held.append((doc, None))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (own, other)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, ids in enumerate((a, b)):
            for i, end in zip(ids, ends[k]):
                groups[bisect.bisect_left(cuts, end)][k].append(i)
        links = Counter()
        for x, y in groups:
            for i, m in Counter(x).items():
                for j, n in Counter(y).items():
                    links[i, j] += m * n
        count.update(links.keys())
        held.append((doc, (len(a), len(b), groups, links)))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for doc, found in held:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for pair, n in links.items() if count[pair] == most[pair[0]])
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), best, sum(n * count[pair] for pair, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("packed", [alignment.PACKED, 50])
def test_alignment_rows(spark, monkeypatch, packed):
    monkeypatch.setattr(alignment, "PACKED", packed)
    monkeypatch.setattr(alignment, "BLOCK", (30, 1 << 20))
    docs = odd_docs(spark)
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(x[1] == 0 for x in want) >= 4 and sum(x[1] > 0 for x in want) > 100
    assert rows_of(alignment.align(docs, alignment.public_pair())) == want


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(alignment.op12_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")) == want


def test_alignment_of_nothing(spark):
    assert alignment.align(odd_docs(spark).limit(0), alignment.public_pair()).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert rows_of(alignment.align(nothing, alignment.public_pair())) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_where_vocabularies_can_merge():
    assert alignment.check_vocabularies(["▁a", "▁▁", "b"]) == " \t\n"
    assert alignment.check_vocabularies(["a▁b", ";\n", "▁\t"]) == ""
    assert alignment.public_pair().open().starts == " \t\n"


def plain_whitening(vectors, components=32):
    """By exact integers and a dense eigen decomposition: n, deviations, whitened coordinates, explained shares."""
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    c = n * x - s
    centred = c.astype(float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    with np.errstate(all="ignore"):
        return n, (c * c).sum(1).tolist(), centred @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(out, vectors, components=32, close=1e-9):
    n, deviation, whitened, explained = plain_whitening(vectors, components)
    for k in range(len(explained)):
        own = {r.vec_id: r for r in out if r.component == k + 1}
        got = np.array([own[i].whitened for i in range(len(vectors))])
        assert min(np.abs(got - whitened[:, k]).max(), np.abs(got + whitened[:, k]).max()) < close
        assert all(abs(r.explained - explained[k]) <= 1e-9 * explained[k] and r.n == n and r.identity_error < 1e-9 for r in own.values())
    assert {(r.vec_id, r.deviation) for r in out} == set(enumerate(deviation))
    assert len(out) == len(vectors) * len(explained)


def test_whitening_of_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [r.embedding for r in table.orderBy("vec_id").collect()]
    check_whitening(whitening.op11_whitening(spark, "/root/testdata/sf0.001").collect(), vectors)


def test_range_finder_stops_or_grows(spark):
    """Spectra with a gap end in the first basis, flat ones in the full dimension; both are right."""
    random_ = np.random.default_rng(0)
    for scale, columns in ((np.r_[np.full(4, 1000.0) * np.arange(4, 0, -1), np.zeros(36)], 14), (np.linspace(2, 1, 40), 40)):
        vectors = (random_.standard_normal((300, 40)) * scale).tolist()
        frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
        n, sums = whitening._sums(whitening.usable(frame))[40]
        assert whitening.Basis(whitening.usable(frame), 40, n, sums, 4).columns == columns
        check_whitening(whitening.whiten(frame, 4).collect(), vectors, 4, 1e-7)


def test_whitening_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0, 0.5]), (1, [0.0, 1.0, 0.25]), (1, [0.0, 1.0, 0.25]), (None, [3.0, -1.0, 2.0]), (4, [900.0, 5.0, -2.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 2.0]), (8, [inf, 1.0, 2.0]), (9, []), (10, [1e300, 0.0, 0.0])]
    other = [(11, [1.0, 1.0]), (12, [2.0, 2.0])]
    rows = [(i, v, 1, "n") for i, v in good + bad + other]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string").repartition(4)).collect()
    of = lambda ids: [r for r in out if r.vec_id in ids]
    assert {r.vec_id for r in out} == {0, 1, None, 4, 11, 12}
    assert len(of([0])) == 3 and len(of([1])) == 6 and len(of([None])) == 3 and len(of([11])) == 2
    n, deviation, _, _ = plain_whitening([v for _, v in good])
    assert n == 5 and sorted(r.deviation for r in out if r.component == 1 and r.n == 5) == sorted(deviation)
    # Two points on a line: one component has variance, the other none.
    assert sorted((r.component, r.whitened is None, r.n, None if r.whitened is None else round(abs(r.whitened), 9)) for r in of([11, 12])) == [(1, False, 2, 1.0), (1, False, 2, 1.0), (2, True, 2, None), (2, True, 2, None)]
    alike = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(alike) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in alike)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e13]), (2, [-1e13])], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-12 for r in huge)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
