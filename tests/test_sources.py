"""Readers that split files, line numbers over splits, sinks that survive a kill, corpora with a manifest, discovery."""

import json
import random

import pytest
from pyspark.sql import functions as F

from doselab import schemas
from doselab.functions import text as T
from doselab.operators import dose, evaluation, match, positions
from doselab.plans.design import definitions
from doselab.sources import artefacts, readers, writers


@pytest.fixture
def small_splits(spark):
    """Splits of 700 bytes, so that small files take several tasks."""
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_across_splits(spark, tmp_path, small_splits, end):
    pick = random.Random(1)
    for name in ("a.conllu", "b.conllu"):
        blocks = []
        for i in range(120):
            lines = [f"# sent_id = {i}", f"# source_domain = {name}", f"# text = line {i}"] + [f"{k}\tw{k}\t_\t_\t_\t_\t0\t_\t_\t_" for k in range(1, pick.randint(2, 9))]
            blocks.append(end.join(lines))
        gaps = [end * 2 if pick.random() < 0.7 else end + pick.choice([" ", "\t", ""]) + end + end for _ in blocks]
        (tmp_path / name).write_text(end + "".join(b + g for b, g in zip(blocks[:-1], gaps)) + blocks[-1], newline="")
    read = readers.scan_conllu(spark, str(tmp_path))
    assert readers._records(spark, str(tmp_path), None).rdd.getNumPartitions() > 20
    rows = read.orderBy("seq").collect()
    assert [(r.source_domain, r.sent_id, r.text) for r in rows] == [(n, i, f"line {i}") for n in ("a.conllu", "b.conllu") for i in range(120)]
    assert [r.word_count for r in rows] == [len(r.words) for r in rows] and all(w.text == f"w{w.id}" for r in rows for w in r.words)
    placed = readers.placed_blocks(spark, str(tmp_path)).select("path", "place", readers.header_value(F.col("block"), "sent_id").alias("i")).collect()
    assert len(placed) == 240 and all(r.place == int(r.i) + 1 for r in placed)
    # Metadata alone parses no words.
    assert "conllu_words" not in read.select("sent_id")._jdf.queryExecution().toString() and "words" not in str(read.select("sent_id")._jdf.queryExecution().optimizedPlan())


def test_lines_across_splits(spark, tmp_path, small_splits):
    for name, n in (("x.jsonl", 150), ("y.jsonl", 90)):
        lines = [json.dumps({"item_id": i, "construction": "aann", "good_sentence": f"good {i}", "bad_sentence": f"bad {i}"}) if i % 4 else "" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = readers.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1
    for r in got.where("value <> ''").collect():
        assert json.loads(r.value)["item_id"] == r.line - 1
    assert readers.scan_eval_items(spark, str(tmp_path)).count() == sum(bool(i % 4) for n in (150, 90) for i in range(n))
    assert {r.item_id for r in readers.scan_eval_items(spark, str(tmp_path)).collect()} == {str(i) for i in range(150) if i % 4}
    broken = (tmp_path / "y.jsonl").read_text().split("\n")
    broken[70], broken[33], broken[80] = '{"item_id": 1, "construction": "c", "good_sentence": "g"}', "{no", "[1]"
    (tmp_path / "y.jsonl").write_text("\n".join(broken))
    with pytest.raises(ValueError, match="y.jsonl line 34: no JSON"):
        readers.scan_eval_items(spark, str(tmp_path))
    faults = {(r.file, r.line, r.fault) for r in readers.item_faults(readers.numbered_lines(spark, str(tmp_path))).collect()}
    assert faults == {("y.jsonl", 34, "no JSON"), ("y.jsonl", 71, "missing field 'bad_sentence'"), ("y.jsonl", 81, "no object")}


def test_positions(spark):
    pick = random.Random(2)
    rows = [(pick.choice("aab"), pick.randrange(10**6), i) for i in range(500)]
    got = positions.positioned(spark.createDataFrame(rows, "k string, v long, i int"), ["k"], ["v", "i"]).collect()
    assert {(r.k, r.v, r.i): r.pos for r in got} == {(k, v, i): 1 + sum(o < (v, i) for g, *o_ in rows if g == k for o in [tuple(o_)]) for k, v, i in rows}
    assert sorted(r.i for r in positions.first_rows(spark.createDataFrame(rows, "k string, v long, i int"), ["v", "i"], 20).collect()) == sorted(i for _, i in sorted((v, i) for _, v, i in rows)[:20])
    assert positions.positioned(spark.createDataFrame([], "k string, v long"), ["k"], ["v"]).count() == 0


def test_a_killed_append(spark, tmp_path):
    shape = "model string, seed int, item_id string, correct int"
    rows = spark.createDataFrame([(m, s, f"i{k}", (k + s) % 2) for m in "ab" for s in (1, 2) for k in range(5)], shape)
    sink = writers.ScoredSink(spark, str(tmp_path / "s"), ["model", "seed"], shape)
    assert sink.groups().count() == 0 and sink.items().count() == 0 and sink.pending(rows).count() == 20
    sink.append(rows.where("model = 'a' and seed = 1"))
    dead = sink.write_items(rows.where("seed = 2"))  # killed before its groups' rows
    assert sink.items().count() == 5 and {(r.model, r.seed, r.batch, r.n) for r in sink.orphans().collect()} == {("a", 2, dead, 5), ("b", 2, dead, 5)}
    for _ in range(2):
        sink.append(rows)
        assert sorted(map(tuple, sink.items().collect())) == sorted(map(tuple, rows.collect()))
        right = {s: sum((k + s) % 2 for k in range(5)) for s in (1, 2)}
        assert {(r.model, r.seed): (r.n_pairs, r.n_correct, r.accuracy) for r in sink.groups().collect()} == {(m, s): (5, right[s], right[s] / 5) for m in "ab" for s in (1, 2)}
    # Two appends that raced: both wrote the same groups; the first batch by name counts, once.
    sink.write_groups(dead)
    assert sorted(map(tuple, sink.items().collect())) == sorted(map(tuple, rows.collect())) and sink.groups().count() == 4
    flat = spark.createDataFrame([("a", 1)], "k string, v int")
    for _ in range(2):
        writers.append_results(flat, str(tmp_path / "r"), ["k"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.parquet").write_text("no table")
    with pytest.raises(Exception):
        writers.append_results(flat, str(tmp_path / "t"), ["k"])


def test_corpora_with_a_manifest(spark, tmp_path):
    rows = [(c, d, 10 * i, 1000 - i if i % 5 == 0 else 10 * i, "dom", f"text {c} {i}") for c, d in (("a", "0"), ("a", "all"), ("full", "all")) for i in range(200 if c == "full" else 7)]
    table = spark.createDataFrame(rows, "construction string, dose string, slot_id long, sent_id long, source_domain string, text string").withColumn("words", writers.plain_words(F.col("text")))
    path = str(tmp_path / "c")
    artefacts.write_cell_corpora(table.repartition(5), path)
    got = artefacts.read_cell_corpora(spark, path).select("cell", "pos", readers.header_value(F.col("block"), "sent_id").cast("long").alias("i"), readers.header_value(F.col("block"), "text").alias("t")).orderBy("cell", "pos").collect()
    want = sorted((f"{c}_dose-{d}", s, i, t) for c, d, s, i, _, t in rows)
    assert [(r.cell, r.i, r.t) for r in got] == [(c, i, t) for c, _, i, t in want]
    full = sorted((tmp_path / "c" / "corpora" / "cell=full_dose-all").glob("*.txt"))
    blocks = full[0].read_text().split("\n\n")
    full[0].write_text("\n\n".join([blocks[1], blocks[0], *blocks[2:]]))  # the same blocks in another order
    full[0].with_name(f".{full[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="full_dose-all"):
        artefacts.read_cell_corpora(spark, path)


def test_run_discovery(spark, tmp_path):
    def run(name, *files):
        (tmp_path / name).mkdir(parents=True)
        for f in files:
            (tmp_path / name / f).write_text("x")

    run("ltgbert_aann_D4_seed42", "config.json", "model.safetensors")
    run("deep/er/it_cleft-dose-all-seed-7", "config.json", "pytorch_model.bin", "more.txt")
    run("ltgbert_aann_D0_seed42", "model.safetensors")  # no configuration
    run("ltgbert_aann_D16_seed42", "config.json")  # no weights
    run("notes", "config.json", "model.safetensors")
    got = [(r.construction, r.dose, r.seed, r.path.split("/")[-1], r.named) for r in evaluation.discover_runs(spark, str(tmp_path), ["aann", "it_cleft"]).collect()]
    assert got == [("aann", "4", 42, "ltgbert_aann_D4_seed42", True), ("it_cleft", "all", 7, "it_cleft-dose-all-seed-7", False)]


def test_tokens_and_definitions(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, None if i == 3 else f"Some words, number {i} — é") for i in range(12)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = artefacts.token_counts(spark.createDataFrame(rows, "i int, text string"), path)
    encode = Tokenizer.from_file(path)
    assert {r.i: r.n_tokens for r in counted.collect()} == {i: None if t is None else len(encode.encode(t).ids) for i, t in rows}
    ratio = artefacts.tokens_per_word(counted.where("i <> 3"), F.col("n_tokens"), T.space_count(F.col("text")), "i", 4).first().tokens_per_word
    some = [t for i, t in rows if t][:4]
    assert abs(ratio - sum(len(encode.encode(t).ids) for t in some) / sum(len(t.split()) for t in some)) < 1e-12
    got = definitions(spark, {"a": {"name": "A n", "example": "x y"}, "b": {"name": "B"}}, ["a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [("a", 'A n. Example: "x y"'), ("b", "B"), ("c", "c")]


def test_files_in_and_out(spark, tmp_path):
    table = spark.createDataFrame([(i, "d", f"t {i}") for i in range(30)], "sent_id long, source_domain string, text string").withColumn("words", writers.plain_words(F.col("text")))
    writers.write_conllu(table.repartition(4), str(tmp_path / "pool"), limit=11)
    assert [r.sent_id for r in readers.scan_conllu(spark, str(tmp_path / "pool")).orderBy("seq").collect()] == list(range(11))
    sheet = artefacts.audit_sheet(spark.createDataFrame([(5, 'a "b", c', 1, 2), (4, "d", 0, 1)], "sent_id long, text string, filter_label int, place int"))
    writers.write_csv(sheet, str(tmp_path / "csv"))
    back = readers.scan_csv(spark, str(tmp_path / "csv"), schemas.AUDIT).orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.sentence_text, r.filter_label, r.human_label) for r in back] == [(4, "d", 0, None), (5, 'a "b", c', 1, None)]
    (tmp_path / "sheet.csv").write_text('sentence_id,sentence_text,filter_label,human_label,notes\n1,"x, y",1, 1 ,n\n2,z,0,0,\n3,w,1,,\n')
    labelled = artefacts.scan_audit_sheet(spark, str(tmp_path / "sheet.csv"))
    assert [(r.sentence_id, r.human_label) for r in labelled.orderBy("sentence_id").collect()] == [(1, "1"), (2, "0"), (3, None)]
    r = evaluation.filter_report(labelled).first()
    assert (r.tp, r.tn, r.n_skipped) == (1, 1, 1)
    writers.write_json(sheet, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_chosen_constructions(spark):
    ws = [(1, "there", "there", "PRON", None, None, 2, "expl"), (2, "are", "be", "VERB", None, None, 0, "root"), (3, "cats", "cat", "NOUN", None, None, 2, "nsubj")]
    rows = spark.createDataFrame([(1, "there are cats", ws)], f"sent_id bigint, text string, words {match.WORDS_TYPE}")
    assert [r.construction for r in match.positives(rows, ["existential_there", "aann"]).collect()] == ["existential_there"]
    assert match.positives(rows, ["aann"]).count() == 0
    assert match.match_all(rows, ["it_cleft"]).columns == ["sent_id", "text", "words", "it_cleft"]
    with pytest.raises(KeyError, match="zz"):
        match.positives(rows, ["zz"])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_read_by_patterns(spark):
    """A block is not split for each header and field; headers, ranges, empty nodes and line ends stay as they were."""
    blocks = {
        "# sent_id = 7\n# text = a = b \n# text= c\n1\ta-b\t_\tX\t_\tK=V\t2\tdep\t_\t_\n1-2\tx\n1.1\ty\n#no\n \n2\t-": ("7", "c", 2),
        "# sent_id =\r\n1\tq\r\n2\tr\r\n# text = late": ("", None, 2),
        "#text=only": (None, "only", 0),
        "1\tno head\n# text = x": (None, None, 1),
        "# x\n#\tsent_id = ä\U0001f600 1\n": ("ä\U0001f600 1", None, 0),
    }
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(blocks)], "k int, block string")
    out = rows.select("k", readers.header_value(F.col("block"), "sent_id"), readers.header_value(F.col("block"), "text"), readers.token_count(F.col("block")), readers.conllu_words(F.col("block")).alias("words"))
    got = out.orderBy("k").collect()
    assert [tuple(r)[1:4] for r in got] == list(blocks.values())
    assert [tuple(w) for w in got[0]["words"]] == [(1, "a-b", None, "X", None, "K=V", 2, "dep"), (2, "-", None, None, None, None, None, None)]
    assert [[tuple(r)[1:] for r in readers.word_rows(rows, "k").where(F.col("k") == k).collect()] for k in range(5)] == [[tuple(w) for w in r["words"]] for r in got]
    plan = _plan(out)
    assert plan.count("split(") == 1 and "sent_id" in plan


def test_sorted_blocks_are_made_where_they_are_written(spark, tmp_path):
    table = spark.createDataFrame([(3, "d", " one  two"), (1, "d", "é")], "sent_id long, source_domain string, text string")
    for name, rows in (("plain", table), ("words", table.withColumn("words", writers.plain_words(F.col("text"))))):
        writers.write_conllu(rows, str(tmp_path / name))
    texts = ["".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))) for name in ("plain", "words")]
    assert texts[0] == texts[1] and "\n2\ttwo" + "\t_" * 8 in texts[0]


def test_sentences_move_before_they_are_copied_to_cells(spark):
    """A slot meets its changes once, not once a cell."""
    row = lambda *rows: spark.createDataFrame([(i, "d", t) for i, t in rows], "sent_id long, domain string, text string")
    base, pool = row((1, "a"), (2, "b"), (3, "c")), row((7, "x"), (8, "y"))
    subs = spark.createDataFrame([("p", "0", 1, 7), ("p", "0", 2, None), ("q", "0", 1, 8)], "construction string, dose string, slot_id long, filler_id long")
    cells = spark.createDataFrame([("p", "0"), ("q", "0"), ("p", "all")], "construction string, dose string")
    out = dose.dose_corpus(base, pool, subs, cells)
    got = {c: [(r.slot_id, r.sent_id, r.text) for r in sorted(out.collect()) if (r.construction, r.dose) == c] for c in (("p", "0"), ("q", "0"), ("p", "all"))}
    assert got == {("p", "0"): [(1, 7, "x"), (3, 3, "c")], ("q", "0"): [(1, 8, "y"), (2, 2, "b"), (3, 3, "c")], ("p", "all"): [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]}
    plan = _plan(out)
    assert plan.index("Join Cross") < plan.index("Join LeftOuter")
