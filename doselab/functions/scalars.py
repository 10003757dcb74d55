"""Scalar functions of the exposure analysis, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attested counts where no count table gives one.
ATTESTED = {"aann": 1200, "comparative_correlative": 340, "tough_movement": 890, "resultative": 2100}
#: Fixed value: the seed of the corpus builder.
CORPUS_SEED = 42
#: The two length bands of filler matching.
BANDS = (0.20, 0.40)


def stable_index(key: Column, n: Column, seed: int = CORPUS_SEED) -> Column:
    """First 64 bits of md5("seed:key"), unsigned, modulo n (1 at least)."""
    high = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % F.greatest(n, F.lit(1)).cast("decimal(20,0)")).cast("bigint")


def shuffle_key(key: Column, seed: int = CORPUS_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def is_all(dose: Column) -> Column:
    return F.lower(F.trim(dose)) == "all"


def dose_value(dose: Column, attested: Column) -> Column:
    """The number of a dose; ``all`` is the attested count. Null where neither gives one."""
    return F.when(is_all(dose), attested.cast("double")).otherwise(dose.try_cast("double"))


def attested_count(construction: Column) -> Column:
    pairs = [x for k, v in ATTESTED.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), construction)


def log_dose(value: Column) -> Column:
    return F.log10(value + 1)


def binomial_error(p: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)))).otherwise(0.0)


def length_band(target: Column, length: Column, band: float) -> Column:
    return length.cast("double").between(target * (1 - F.lit(band)), target * (1 + F.lit(band)))


def expected_count(dose: Column, total: Column) -> Column:
    return F.when(is_all(dose), total).otherwise(F.least(dose.try_cast("bigint"), total))


def run_name(construction: Column, dose: Column, seed: Column) -> Column:
    return F.format_string("ltgbert_%s_D%s_seed%s", construction, dose, seed.cast("string"))


def pair_correct(good: Column, bad: Column) -> Column:
    return (good > bad).cast("int")


def hill(dose: Column, low: Column, top: Column, half: Column, n: Column) -> Column:
    """The four-parameter saturating curve, in a form that can't overflow."""
    d = F.greatest(dose, F.lit(0.0))
    return F.when(d == 0, low).otherwise(low + (top - low) / (1 + F.pow(half / F.when(d == 0, 1.0).otherwise(d), n)))


def power_curve(dose: Column, a: Column, b: Column, c: Column) -> Column:
    return a * F.pow(dose + 1, b) + c


def log_linear(dose: Column, a: Column, b: Column) -> Column:
    return a + b * F.ln(dose + 1)


def step_curve(dose: Column, low: Column, high: Column, threshold: Column) -> Column:
    return F.when(dose >= threshold, high).otherwise(low)


def leakage_note(recall: Column, source: Column) -> Column:
    percent = F.format_string("%.1f", (1 - recall) / F.when(recall > 0, recall) * 100)
    return F.when(recall <= 0, F.concat(F.lit("leakage bound undefined (recall 0, "), source, F.lit(")"))).otherwise(
        F.concat(F.lit("up to "), percent, F.lit("% unfiltered instances may remain (recall "), F.format_string("%.2f", recall), F.lit(", "), source, F.lit(")"))
    )


def warmup_cosine(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Learning rate: a linear rise, then a cosine fall to 0."""
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def relative_gain(top: Column, low: Column) -> Column:
    return F.try_divide(top - low, F.nullif(top, F.lit(0.0)))
