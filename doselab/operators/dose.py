"""Dose-controlled corpora: which positives stay, what replaces the others, and the proof that it worked.

All corpora of one construction differ only in flipped slots, so nothing is copied per cell: a corpus is a view of
the base and a small table of substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.functions import scalars as S
from doselab.operators.sizes import hinted, marked
from doselab.operators.stable import written

#: Pool rows in a chunk of the filler index: what one look-up may have to sort.
CHUNK_BITS = 12


def ladder(positives: DataFrame) -> DataFrame:
    """positives (construction, sent_id, ...) with rank, from 1: the one shuffled order of a construction for all its doses.

    The order is that of a hash, so its first digits deal a construction into 4096 parts of even size: counts of parts
    run first, then ranks inside them.
    """
    keyed = positives.withColumn("_key", S.shuffle_key(F.col("sent_id"))).withColumn("_part", F.substring("_key", 1, 3))
    sums = keyed.groupBy("construction", "_part").agg(F.count("*").alias("_n"))
    # At most 4096 rows a construction are summed in one window.
    before = sums.select("construction", "_part", (F.sum("_n").over(W.partitionBy("construction").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("construction", "_part").orderBy("_key", "sent_id"))
    ranked = keyed.withColumn("_inside", inside).join(before, ["construction", "_part"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_key", "_part", "_before", "_inside")


def keep_positives(positives: DataFrame, cells: DataFrame) -> DataFrame:
    """construction, dose, sent_id, rank, kept. positives: construction, sent_id, ...; cells: construction, dose.

    The first of the ladder stay, so what a dose keeps every higher dose keeps.
    """
    keep = F.when(S.is_all(F.col("dose")), True).otherwise(F.col("rank") <= F.col("dose").try_cast("bigint"))
    return ladder(positives).join(hinted(cells.select("construction", "dose")), "construction").withColumn("kept", keep)


def filler_index(pool: DataFrame) -> DataFrame:
    """domain, chunk, len, ids: the pool in order of domain and id, cut into chunks of 4096 rows; of each length of a chunk
    its ids, ascending. pool: sent_id, domain, n."""
    # Written narrow first: ranges are cut from a sample, which would read the texts a second time.
    rows = written(pool.select("domain", F.col("n").cast("bigint").alias("len"), F.col("sent_id").alias("id")), "pool")
    placed = rows.repartitionByRange("domain", "id").sortWithinPartitions("domain", "id")
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    return written(placed.withColumn("chunk", chunk).groupBy("domain", "chunk", "len").agg(F.sort_array(F.collect_list("id")).alias("ids")), "fillers")


def match_filler(slots: DataFrame, pool: DataFrame, pick: str = "hash") -> DataFrame:
    """sent_id, filler_id (null without pool rows of the domain), tier, n_candidates, rank (from 0), delta.

    slots, pool: sent_id, domain, n. Candidates are the pool rows of the same domain within the narrow length band,
    else the wide one, else all; ordered by length difference and id, one is picked by the slot's hash (or the
    nearest). Slots never meet candidates. Counts by (domain, length) answer for each slot length that occurs how many
    candidates there are up to each difference; the difference at which a slot's place lies leaves at most two
    lengths. Their counts by chunk, summed in order of ids, are cut into blocks of places, and a slot's block is a key
    that no domain or pair of lengths fills alone. The chunk found holds the filler among its ids of both lengths.
    """
    index = filler_index(pool)
    hist = index.select("domain", "chunk", "len", F.size("ids").cast("bigint").alias("c"))
    slot = written(slots.select("sent_id", "domain", F.col("n").cast("bigint").alias("n")), "slots")
    place = S.stable_index(F.col("sent_id"), F.col("n_candidates")) if pick == "hash" else F.lit(0).cast("bigint")
    asks = written(_at_difference(slot, hist, place), "asks")
    # Each pair of lengths that is asked for, with its counts by chunk.
    pair = ["domain", "low", "high"]
    lens = asks.select(*pair).distinct().withColumn("len", F.explode(F.array_distinct(F.array("low", "high"))))
    own = W.partitionBy(*pair)
    runs = hist.join(hinted(lens), ["domain", "len"]).groupBy(*pair, "chunk").agg(F.sum("c").alias("c"))
    runs = runs.withColumn("upto", F.sum("c").over(own.orderBy("chunk"))).withColumn("wide", F.ceil(F.sum("c").over(own) / F.count("*").over(own)).cast("bigint"))
    runs = written(runs.withColumn("since", F.col("upto") - F.col("c")), "runs")
    asks = asks.join(hinted(runs.groupBy(*pair).agg(F.first("wide").alias("wide"))), pair).withColumn("block", F.expr("place div wide")).drop("wide")
    blocks = runs.select(*pair, "chunk", "since", "upto", F.explode(F.sequence(F.expr("since div wide"), F.expr("(upto - 1) div wide"))).alias("block"))
    found = asks.join(blocks, [*pair, "block"]).where((F.col("place") >= F.col("since")) & (F.col("place") < F.col("upto")))
    for name in ("low", "high"):
        found = found.join(index.select("domain", "chunk", F.col("len").alias(name), F.col("ids").alias(f"_{name}")), ["domain", "chunk", name], "left")
    none = F.array().cast("array<bigint>")
    ids = F.sort_array(F.concat(F.coalesce("_low", none), F.when(F.col("low") == F.col("high"), none).otherwise(F.coalesce("_high", none))))
    found = found.select("sent_id", F.element_at(ids, (F.col("place") - F.col("since") + 1).cast("int")).alias("filler_id"), "tier", "n_candidates", (F.col("first") + F.col("place")).alias("rank"), "delta")
    return slot.select("sent_id").join(found, "sent_id", "left")


def _at_difference(slot: DataFrame, hist: DataFrame, place: Column) -> DataFrame:
    """sent_id, domain, tier, n_candidates, first, delta, low, high, place: the length difference at which a slot's place lies,
    how many candidates are nearer, the lengths at that difference, and the place among their ids."""
    lengths = hist.groupBy("domain", "len").agg(F.sum("c").alias("c"))
    # Distinct lengths of slots with distinct lengths of the pool: as many rows as a domain has pairs of lengths.
    met = slot.select("domain", "n").distinct().join(hinted(lengths), "domain").withColumn("delta", F.abs(F.col("len") - F.col("n")))
    tier = F.when(S.length_band(F.col("n"), F.col("len"), S.BANDS[0]), 1).when(S.length_band(F.col("n"), F.col("len"), S.BANDS[1]), 2).otherwise(3)
    own = W.partitionBy("domain", "n")
    met = met.withColumn("t", tier).withColumn("tier", F.min("t").over(own)).where(F.col("t") == F.col("tier"))
    met = met.groupBy("domain", "n", "tier", "delta").agg(F.sum("c").alias("c"), F.min("len").alias("low"), F.max("len").alias("high"))
    met = met.withColumn("upto", F.sum("c").over(own.orderBy("delta")))
    plans = met.groupBy("domain", "n", "tier").agg(F.sum("c").alias("n_candidates"), F.sort_array(F.collect_list(F.struct("upto", "c", "delta", "low", "high"))).alias("_steps"))
    out = slot.join(hinted(plans), ["domain", "n"]).withColumn("_place", place)
    out = out.withColumn("_at", F.get(F.filter("_steps", lambda s: s["upto"] > F.col("_place")), F.lit(0)))
    first = F.col("_at.upto") - F.col("_at.c")
    return out.select("sent_id", "domain", "tier", "n_candidates", first.alias("first"), "_at.delta", "_at.low", "_at.high", (F.col("_place") - first).alias("place"))


def match_filler_rows(slots: DataFrame, pool: DataFrame) -> DataFrame:
    """match_filler() in its plain form, over all pairs of a domain; for small pools and for tests."""
    own = W.partitionBy("sent_id")
    met = slots.select("sent_id", "domain", "n").join(pool.select("domain", F.col("n").alias("len"), F.col("sent_id").alias("filler_id")), "domain")
    tier = F.when(S.length_band(F.col("n"), F.col("len"), S.BANDS[0]), 1).when(S.length_band(F.col("n"), F.col("len"), S.BANDS[1]), 2).otherwise(3)
    met = met.withColumn("t", tier).withColumn("tier", F.min("t").over(own)).where(F.col("t") == F.col("tier"))
    met = met.withColumn("o", F.row_number().over(own.orderBy(F.abs(F.col("len") - F.col("n")), "filler_id")) - 1).withColumn("n_candidates", F.count("*").over(own))
    found = met.where(F.col("o") == S.stable_index(F.col("sent_id"), F.col("n_candidates"))).select("sent_id", "filler_id", "tier", "n_candidates")
    return slots.select("sent_id").join(found, "sent_id", "left")


def substitutions(kept: DataFrame, fillers: DataFrame) -> DataFrame:
    """construction, dose, slot_id, filler_id of all removed positives. kept: keep_positives()."""
    removed = kept.where(~F.col("kept")).select("construction", "dose", F.col("sent_id").alias("slot_id"))
    return removed.join(fillers.select(F.col("sent_id").alias("slot_id"), "filler_id"), "slot_id", "left").select("construction", "dose", "slot_id", "filler_id")


def changes(ranked: DataFrame, fillers: DataFrame, pool: DataFrame) -> DataFrame:
    """construction, rank, slot_id, sent_id, domain, text, sign: what the removal of each positive changes, once for all doses.

    Its own row leaves (sign -1) and its filler comes (sign 1). ranked: ladder() with domain and text; pool: sent_id, domain, text.
    """
    out = ranked.select("construction", "rank", F.col("sent_id").alias("slot_id"), "sent_id", "domain", "text", F.lit(-1).alias("sign"))
    new = ranked.select("construction", "rank", F.col("sent_id").alias("slot_id")).join(fillers.where("filler_id is not null").select(F.col("sent_id").alias("slot_id"), F.col("filler_id").alias("sent_id")), "slot_id")
    new = written(new, "new")
    # The pool's texts are many times those that come.
    new = new.join(marked(pool.select("sent_id", "domain", "text"), new, "sent_id"), "sent_id").withColumn("sign", F.lit(1))
    return out.unionByName(new)


def _numbered(cells: DataFrame) -> DataFrame:
    return cells.select("construction", "dose", F.when(~S.is_all(F.col("dose")), F.col("dose").try_cast("bigint")).alias("_dose")).where("_dose is not null").distinct()


def stepped(changed: DataFrame, cells: DataFrame) -> DataFrame:
    """changed (construction, rank, ...) with step: the largest dose of the construction that leaves the rank out.

    Every dose up to step has the change, so a change is counted once, not once a cell. Changes that no cell has go.
    """
    doses = _numbered(cells).groupBy("construction").agg(F.collect_set("_dose").alias("_doses"))
    out = changed.join(hinted(doses), "construction").withColumn("step", F.array_max(F.filter("_doses", lambda d: d < F.col("rank"))))
    return out.where("step is not null").drop("_doses")


def by_cell(deltas: DataFrame, cells: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """construction, dose, keys and the sums of what the cell has of deltas (construction, step, keys, sums)."""
    met = deltas.join(hinted(_numbered(cells)), "construction").where(F.col("step") >= F.col("_dose"))
    return met.groupBy("construction", "dose", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def corpus_totals(base: DataFrame, changed: DataFrame, cells: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """construction, dose and sums over the rows of every cell's corpus, without building any: the base's sums, once, and the
    signed sums of each cell's substitutions. sums: expressions over slot_id, sent_id, domain, text."""
    once = base.withColumn("slot_id", F.col("sent_id")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{n}") for n, c in sums.items()])
    moved = stepped(changed, cells).groupBy("construction", "step").agg(*[F.sum(F.col("sign") * c).alias(n) for n, c in sums.items()])
    own = by_cell(moved, cells, [], list(sums))
    out = cells.select("construction", "dose").distinct().join(own, ["construction", "dose"], "left").crossJoin(F.broadcast(once))  # one row
    return out.select("construction", "dose", *[(F.col(f"_{n}") + F.coalesce(n, F.lit(0))).alias(n) for n in sums])


def observed_hits(hits: DataFrame, changed: DataFrame, cells: DataFrame, hit: Column) -> DataFrame:
    """construction, dose, observed: hits in every cell's corpus. hits: a row a hit of the base (construction); hit: whether a row of
    changed (construction, text) is one of its construction."""
    once = hits.groupBy("construction").agg(F.count("*").alias("_once"))
    moved = stepped(changed, cells).where(hit).groupBy("construction", "step").agg(F.sum("sign").alias("observed"))
    out = cells.select("construction", "dose").distinct().join(hinted(once), "construction", "left").join(by_cell(moved, cells, [], ["observed"]), ["construction", "dose"], "left")
    return out.select("construction", "dose", (F.coalesce("_once", F.lit(0)) + F.coalesce("observed", F.lit(0))).alias("observed"))


def dose_corpus(base: DataFrame, pool: DataFrame, subs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """construction, dose, slot_id, sent_id, domain, text of every cell; order by slot_id is corpus order.

    cells: construction, dose. A cell that removes nothing is the base unchanged; without cells, those in subs only.

    Removed slots with a filler hold the filler's row and id; without one they are dropped.
    """
    cells = (subs if cells is None else cells).select("construction", "dose").distinct()
    changed = subs.join(pool.select(F.col("sent_id").alias("filler_id"), F.col("domain").alias("_d"), F.col("text").alias("_t")), "filler_id", "left")
    # A slot meets its changes (one a cell at most) before it is copied to the cells, so that texts move once and not once a cell.
    by_slot = changed.groupBy("slot_id").agg(F.collect_list(F.struct("construction", "dose", "filler_id", "_d", "_t")).alias("_changes"))
    rows = base.select(F.col("sent_id").alias("slot_id"), "domain", "text").join(by_slot, "slot_id", "left").crossJoin(hinted(cells))
    own = F.get(F.filter("_changes", lambda c: (c["construction"] == F.col("construction")) & (c["dose"] == F.col("dose"))), F.lit(0))
    out = rows.withColumn("_own", F.when(F.col("_changes").isNotNull(), own))
    out = out.where(F.col("_own").isNull() | F.col("_own.filler_id").isNotNull())
    return out.select("construction", "dose", "slot_id", F.coalesce("_own.filler_id", "slot_id").alias("sent_id"), F.coalesce("_own._d", "domain").alias("domain"), F.coalesce("_own._t", "text").alias("text"))


def slotted(base: DataFrame, pool: DataFrame, subs: DataFrame, cell: Column) -> DataFrame:
    """slot_id, domain, text and changes of every row of base: what dose_corpus() has, a row a slot and not a row a cell.

    changes (null without any): an array of cells (names by cell, an expression over construction and dose) with the sent_id, domain and
    text that they have in the slot; null where the slot is dropped. subs: substitutions().
    """
    own = written(subs.groupBy("slot_id", F.col("filler_id").alias("sent_id")).agg(F.collect_set(cell).alias("cells")), "subs")
    texts = marked(pool.select("sent_id", "domain", "text"), own.where("sent_id is not null"), "sent_id")
    changed = own.join(texts, "sent_id", "left").groupBy("slot_id").agg(F.collect_list(F.struct("cells", "sent_id", "domain", "text")).alias("changes"))
    return base.select(F.col("sent_id").alias("slot_id"), "domain", "text").join(changed, "slot_id", "left")


def dose_audit(kept: DataFrame, fillers: DataFrame, base_words: DataFrame | None = None) -> DataFrame:
    """One row a cell: totals, kept, removed, replaced, unmatched, words kept, ordered ids and assignments."""
    all_ = kept.join(fillers.select("sent_id", "filler_id"), "sent_id", "left")
    gone = ~F.col("kept")
    ids = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("sent_id"))))
    pairs = F.sort_array(F.collect_list(F.when(gone & F.col("filler_id").isNotNull(), F.struct(F.col("sent_id").cast("string"), "filler_id"))))
    return all_.groupBy("construction", "dose").agg(
        F.count("*").alias("n_positive_total"), F.count_if("kept").alias("n_kept"), F.count_if(gone).alias("n_removed"),
        F.count_if(gone & F.col("filler_id").isNotNull()).alias("n_replaced"), F.count_if(gone & F.col("filler_id").isNull()).alias("n_unmatched"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0)).cast("bigint").alias("kept_positive_words"),
        ids(F.col("kept")).alias("kept_positive_ids"), ids(gone).alias("removed_positive_ids"), ids(gone & F.col("filler_id").isNull()).alias("unmatched_removed_ids"),
        F.map_from_entries(pairs).alias("replacement_assignments"),
    )


def dose_sanity(audit: DataFrame, observed: DataFrame) -> DataFrame:
    """construction, dose, expected, observed, pass. observed: construction, dose, observed (hits counted anew)."""
    expected = S.expected_count(F.col("dose"), F.col("n_positive_total")).cast("bigint")
    out = audit.select("construction", "dose", expected.alias("expected")).join(observed, ["construction", "dose"], "left")
    seen = F.coalesce("observed", F.lit(0)).cast("bigint")
    return out.select("construction", "dose", "expected", seen.alias("observed"), (F.col("expected") == seen).alias("pass"))
