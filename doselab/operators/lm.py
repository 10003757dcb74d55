"""Count-based language models: unigrams, interpolated n-grams, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doselab.functions import scalars as S
from doselab.functions.text import word_tokens
from doselab.operators import dose, evaluation, tallies
from doselab.operators.sizes import BROADCAST_ROWS, hinted
from doselab.operators.stable import written

#: Fixed values of the n-gram model: weights of orders 3, 2, 1, of the smoothed unigram, its add-k, the floor.
WEIGHTS, BASE_WEIGHT, ADD_K, FLOOR = {3: 0.5, 2: 0.25, 1: 0.15}, 0.10, 0.01, 1e-12
ORDER = 4
BOS, EOS = "<s>", "</s>"


def unigram_counts(texts: DataFrame, *by: str) -> DataFrame:
    """w, c (per by-columns) over column text."""
    return texts.select(*by, F.explode(word_tokens(F.col("text"))).alias("w")).groupBy(*by, "w").agg(F.count("*").alias("c"))


def unigram_logprob(texts: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key, logprob, n_tokens: sum of ln(count / total), unseen words counting once. counts: w, c."""
    total = counts.agg(F.sum("c").alias("total"))
    tokens = texts.select(key, F.explode_outer(word_tokens(F.col("text"))).alias("w"))
    scored = tokens.join(counts, "w", "left").crossJoin(F.broadcast(total))
    p = F.ln(F.coalesce(F.greatest("c", F.lit(1)), F.lit(1)) / F.col("total"))
    return scored.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), p)), F.lit(0.0)).alias("logprob"), F.count("w").alias("n_tokens"))


def slor(logp: Column, unigram: Column, n_tokens: Column) -> Column:
    return (logp - unigram) / F.greatest(n_tokens, F.lit(1))


def perplexity(losses: DataFrame) -> DataFrame:
    """exp of the token-weighted mean loss; NaN without tokens. losses: loss, n."""
    n = F.sum("n")
    return losses.agg(F.when(n > 0, F.exp(F.sum(F.col("loss") * F.col("n")) / n)).otherwise(F.lit(float("nan"))).alias("perplexity"))


def _padded(text: Column) -> Column:
    """The tokens with three <s> before and one </s> after."""
    return F.concat(F.array(*[F.lit(BOS)] * (ORDER - 1)), word_tokens(text), F.array(F.lit(EOS)))


def _positions(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, _a, _b, _c, w: every position of the padded tokens with the three before it."""
    rows = texts.select(*keys, _padded(F.col("text")).alias("_p")).select(*keys, "_p", F.posexplode(F.slice("_p", F.lit(ORDER), F.size("_p"))).alias("pos", "w"))
    return rows.select(*keys, "pos", *[F.get("_p", F.col("pos") + k).alias(c) for k, c in enumerate(("_a", "_b", "_c"))], "w")


def grams(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, o, ctx, w for every position of the padded tokens and every order."""
    contexts = [F.lit(""), F.col("_c"), F.concat_ws(" ", "_b", "_c"), F.concat_ws(" ", "_a", "_b", "_c")]
    each = F.array(*[F.struct(F.lit(o).alias("o"), c.alias("ctx")) for o, c in enumerate(contexts)])
    return _positions(texts, *keys).select(*keys, "pos", F.inline(each), "w").select(*keys, "pos", "o", "ctx", "w")


def _longest(texts: DataFrame, *by: str) -> DataFrame:
    """by, g, c: counts of the longest n-grams, words joined by spaces."""
    return _positions(texts, *by).select(*by, F.concat_ws(" ", "_a", "_b", "_c", "w").alias("g")).groupBy(*by, "g").agg(F.count("*").alias("c"))


def _orders(longest: DataFrame, single: DataFrame, *by: str) -> DataFrame:
    """by, o, ctx, w, c of all orders. longest: by, g, c; single: by, w, c. The counts of an order are sums of the next longer one's,
    so a position is shuffled once and not once an order."""
    out = single.select(*by, F.lit(0).alias("o"), F.lit("").alias("ctx"), "w", "c")
    for o in range(ORDER - 1, 0, -1):
        out = out.unionByName(longest.select(*by, F.lit(o).alias("o"), F.substring_index("g", " ", o).alias("ctx"), F.substring_index("g", " ", -1).alias("w"), "c"))
        longest = longest.select(*by, F.substr("g", F.instr("g", " ") + 1).alias("g"), "c").groupBy(*by, "g").agg(F.sum("c").alias("c"))
    return out


def ngram_counts(texts: DataFrame, *by: str) -> DataFrame:
    """o, ctx, w, c (per by-columns); ctx is the o words before, joined by spaces."""
    words = F.explode(F.concat(word_tokens(F.col("text")), F.array(F.lit(EOS)))).alias("w")
    return _orders(_longest(texts, *by), texts.select(*by, words).groupBy(*by, "w").agg(F.count("*").alias("c")), *by)


def gram_counts(texts: DataFrame, *by: str) -> DataFrame:
    """ngram_counts() with each order counted by itself: for look-ups, as a semi join with few contexts goes below the count."""
    return grams(texts, *by).groupBy(*by, "o", "ctx", "w").agg(F.count("*").alias("c"))


def signed_ngram_counts(base_counts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Counts of a corpus that differs from the base by removed and added sentences; contexts never cross sentences.

    base_counts: ngram_counts(). Signed sums of the longest n-grams give those of the shorter ones.
    """
    change = _longest(removed).withColumn("c", -F.col("c")).unionByName(_longest(added))
    base = base_counts.where(F.col("o") == ORDER - 1).select(F.concat_ws(" ", "ctx", "w").alias("g"), "c")
    longest = base.unionByName(change).groupBy("g").agg(F.sum("c").alias("c")).where("c <> 0")
    words = base_counts.where("o = 0").select("w", "c").unionByName(change.select(F.substring_index("g", " ", -1).alias("w"), "c"))
    return _orders(longest, words.groupBy("w").agg(F.sum("c").alias("c"))).where("c <> 0")


def changed_ngram_counts(texts: DataFrame) -> DataFrame:
    """signed_ngram_counts() from texts alone. texts: text and sign, a row for each time that a sentence counts (1) or is taken away (-1).

    A sentence's signs meet in the task that reads it, and nothing that is counted is shuffled again to meet its changes.
    """
    longest = _positions(texts, "sign").select(F.concat_ws(" ", "_a", "_b", "_c", "w").alias("g"), "sign").groupBy("g").agg(F.sum("sign").alias("c")).where("c <> 0")
    words = texts.select("sign", F.explode(F.concat(word_tokens(F.col("text")), F.array(F.lit(EOS)))).alias("w"))
    return _orders(longest, words.groupBy("w").agg(F.sum("sign").alias("c"))).where("c <> 0")


def ngram_scores(items: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key, score: mean log probability a position (tokens + 1 of them). items: key, text; counts: gram_counts().

    Only contexts that the items hold are counted and totalled: a semi join, which goes below the count where the
    contexts are few enough to broadcast. Order 0 has one context; its total is an aggregate. Both are written, so that
    texts are counted once for each.
    """
    asked = grams(items, key)
    wanted = asked.where("o > 0").select("o", "ctx").distinct()
    near = written(counts.where("o > 0").join(hinted(wanted), ["o", "ctx"], "left_semi"), "near")
    total = near.groupBy("o", "ctx").agg(F.sum("c").alias("t"))
    unigrams = written(counts.where("o = 0"), "unigrams")
    size = unigrams.agg(F.sum("c").alias("total"), F.count("*").alias("vocab"))
    words = asked.where("o = 0").select("w").distinct()
    single = unigrams.join(hinted(words), "w", "left_semi").select("o", "ctx", "w", "c", F.lit(None).cast("bigint").alias("t"))
    known = near.join(total, ["o", "ctx"]).select("o", "ctx", "w", "c", "t").unionByName(single)
    found = asked.join(known, ["o", "ctx", "w"], "left").crossJoin(F.broadcast(size))
    weight = F.when(F.col("o") == 3, WEIGHTS[3]).when(F.col("o") == 2, WEIGHTS[2]).when(F.col("o") == 1, WEIGHTS[1])
    mle = F.coalesce(F.col("c") / F.col("t"), F.lit(0.0))
    unigram = F.lit(BASE_WEIGHT) * (F.coalesce("c", F.lit(0)) + F.lit(ADD_K)) / (F.col("total") + F.lit(ADD_K) * F.col("vocab"))
    p = found.groupBy(key, "pos").agg(F.sum(F.when(F.col("o") == 0, unigram).otherwise(weight * mle)).alias("p"))
    return p.groupBy(key).agg((F.sum(F.ln(F.greatest("p", F.lit(FLOOR)))) / F.count("*")).alias("score"))


def score_pairs(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, construction, good, bad, correct. items: item_id, construction, good_sentence, bad_sentence."""
    both = items.select("item_id", "construction", F.explode(F.create_map(F.lit("good"), "good_sentence", F.lit("bad"), "bad_sentence")).alias("side", "text"))
    keyed = both.withColumn("_k", F.struct("item_id", "construction", "side"))
    scored = ngram_scores(keyed, counts, "_k").select("_k.*", "score")
    wide = scored.groupBy("item_id", "construction").pivot("side", ["good", "bad"]).agg(F.first("score"))
    return wide.withColumn("correct", (F.col("good") > F.col("bad")).cast("int"))


def cell_sizes(words: DataFrame, moved: DataFrame, cells: DataFrame) -> DataFrame:
    """construction, dose, total, vocab of every cell. words: w, c (counts of the base); moved: construction, dose, w, d (signed)."""
    base = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_t"), F.count("*").alias("_v"))
    before, after = F.coalesce("c", F.lit(0)) > 0, F.coalesce("c", F.lit(0)) + F.col("d") > 0
    delta = moved.join(words, "w", "left").groupBy("construction", "dose").agg(F.sum("d").alias("_dt"), F.sum(after.cast("int") - before.cast("int")).alias("_dv"))
    out = cells.select("construction", "dose").distinct().join(delta, ["construction", "dose"], "left").crossJoin(F.broadcast(base))  # one row
    return out.select("construction", "dose", (F.col("_t") + F.coalesce("_dt", F.lit(0))).alias("total"), (F.col("_v") + F.coalesce("_dv", F.lit(0))).alias("vocab"))


def asked_counts(texts: DataFrame, asked: DataFrame, *by: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """by, o, ctx, w, c: partial counts, to be summed, of all words (o = 0), of n-grams that asked holds, and of its contexts
    (w null: whatever word follows). asked: grams() of the items.

    The items' own n-grams go to the tasks and a text's positions are counted where they are read; what follows a context
    otherwise is only added to its total, so that few rows leave. If the items hold more than limit longest n-grams,
    every position meets them by joins.
    """
    windows = asked.where(F.col("o") == ORDER - 1).select("ctx", "w").distinct().limit(limit + 1).collect()  # bounded
    if len(windows) <= limit:
        index = tallies.Index([[*r.ctx.split(" "), r.w] for r in windows], ORDER, BOS, EOS)
        return tallies.tallied(texts, index, *by)
    keys = asked.where("o > 0").select("o", "ctx", "w").distinct()
    each = grams(texts, *by)
    near = each.where("o > 0").join(keys.select("o", "ctx").distinct(), ["o", "ctx"], "left_semi").groupBy(*by, "o", "ctx", "w").agg(F.count("*").alias("c"))
    near = written(near, "near")
    out = each.where("o = 0").groupBy(*by, "o", "ctx", "w").agg(F.count("*").alias("c"))
    out = out.unionByName(near.join(keys, ["o", "ctx", "w"], "left_semi"))
    return out.unionByName(near.groupBy(*by, "o", "ctx").agg(F.sum("c").alias("c")).withColumn("w", F.lit(None).cast("string")))


def cell_scores(items: DataFrame, texts: DataFrame, changed: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """construction, dose, key, score: every item under the model of every cell's corpus.

    One index of counts serves all cells: the base's, of which only unigrams, the items' n-grams and the totals of their
    contexts are kept, so the base is read once. A cell has signed changes to it, resolved where an item looks up a count. Rows
    are items' positions by cells, which is the result's own size; nothing has a row a cell and a base count.
    texts: text of the base; changed: dose.changes(); cells: construction, dose; items: key, text.
    """
    asked = written(grams(items, key), "asked")
    gram, cell = ["o", "ctx", "w"], ["construction", "dose"]
    known = written(asked_counts(texts, asked).groupBy(*gram).agg(F.sum("c").alias("c")), "known")
    signed = asked_counts(dose.stepped(changed, cells), asked, "construction", "step", "sign").groupBy("construction", "step", *gram)
    signed = written(signed.agg(F.sum(F.col("sign") * F.col("c")).alias("d")).where("d <> 0"), "signed")
    # All changed words count for a cell's size; they move once, by word, before they are copied to the cells.
    words = signed.where("o = 0").select("construction", "step", "w", "d")
    sizes = cell_sizes(known.where("o = 0").select("w", "c"), dose.by_cell(words.repartition("w"), cells, ["w"], ["d"]), cells)
    # All other look-ups are of what the items hold.
    own = hinted(asked.where("o = 0").select("w").distinct())
    only = lambda rows: rows.where("o > 0").unionByName(rows.where("o = 0").join(own, "w", "left_semi").select(*rows.columns))
    moved = written(dose.by_cell(only(signed), cells, gram, ["d"]), "moved")
    totals = known.where("w is null").select("o", "ctx", F.col("c").alias("t"))
    shifts = moved.where("w is null").select(*cell, "o", "ctx", F.col("d").alias("dt"))
    found = asked.join(only(known), gram, "left").join(totals, ["o", "ctx"], "left").crossJoin(hinted(sizes))
    found = found.join(moved, [*cell, *gram], "left").join(shifts, [*cell, "o", "ctx"], "left")
    zero = F.lit(0)
    c, t = F.coalesce("c", zero) + F.coalesce("d", zero), F.coalesce("t", zero) + F.coalesce("dt", zero)
    weight = F.when(F.col("o") == 3, WEIGHTS[3]).when(F.col("o") == 2, WEIGHTS[2]).when(F.col("o") == 1, WEIGHTS[1])
    unigram = F.lit(BASE_WEIGHT) * (c + F.lit(ADD_K)) / (F.col("total") + F.lit(ADD_K) * F.greatest("vocab", F.lit(1)))
    p = found.groupBy(*cell, key, "pos").agg(F.sum(F.when(F.col("o") == 0, unigram).otherwise(weight * F.coalesce(F.try_divide(c, t), F.lit(0.0)))).alias("p"))
    return p.groupBy(*cell, key).agg((F.sum(F.ln(F.greatest("p", F.lit(FLOOR)))) / F.count("*")).alias("score"))


def cell_accuracy(items: DataFrame, texts: DataFrame, changed: DataFrame, cells: DataFrame, seeds: list[int]) -> DataFrame:
    """The table of results of the count model: model_construction, dose, seed, eval_construction, n_pairs, n_correct, accuracy, std_error.

    The model has no seed: each seed gets the same row. items: item_id, construction, good_sentence, bad_sentence.
    """
    side = F.explode(F.create_map(F.lit("good"), "good_sentence", F.lit("bad"), "bad_sentence")).alias("side", "text")
    keyed = items.select("item_id", F.col("construction").alias("eval_construction"), side).withColumn("_k", F.struct("item_id", "eval_construction", "side"))
    # Scores that are equal but for the order of summing are ties, and ties are no hits.
    scored = cell_scores(keyed, texts, changed, cells, "_k").select(F.col("construction").alias("model_construction"), "dose", "_k.*", F.round("score", 9).alias("score"))
    cell = ["model_construction", "dose", "eval_construction"]
    both = scored.groupBy(*cell, "item_id").agg(F.max(F.when(F.col("side") == "good", F.col("score"))).alias("_good"), F.max(F.when(F.col("side") == "bad", F.col("score"))).alias("_bad"))
    out = evaluation.pair_accuracy(both.withColumn("correct", S.pair_correct(F.col("_good"), F.col("_bad"))), *cell)
    return evaluation.seed_replicate(out, seeds)
