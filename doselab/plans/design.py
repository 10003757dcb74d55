"""The experiment's design: constructions, doses, seeds, and the cells they make."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the default design.
CORE = ["aann", "comparative_correlative", "tough_movement", "resultative"]
BREADTH = ["existential_there", "it_cleft", "negative_inversion", "subject_to_object_raising"]
CORE_DOSES, BREADTH_DOSES, SEEDS = [0, 4, 16, 64], [0], [42, 43, 44]
FULL = "full"


class Design:
    """core and breadth constructions with their doses; one shared full corpus as the ceiling of all."""

    def __init__(self, core=CORE, breadth=BREADTH, core_doses=CORE_DOSES, breadth_doses=BREADTH_DOSES, seeds=SEEDS, shared_full=True):
        self.core, self.breadth, self.core_doses, self.breadth_doses, self.seeds, self.shared_full = list(core), list(breadth), list(core_doses), list(breadth_doses), list(seeds), shared_full

    @classmethod
    def from_config(cls, config: dict) -> Design:
        """A design block of a configuration, or the full grid of constructions by doses if it has none."""
        block = config.get("design")
        if block:
            return cls(block["core_constructions"], block.get("breadth_constructions", []), block["core_doses"], block.get("breadth_doses", [0]), block.get("seeds", SEEDS), block.get("shared_full_corpus", True))
        return cls(config.get("constructions", CORE), [], config.get("doses", [0, 4, 16, 64, "all"]), [], config.get("seeds", SEEDS), False)

    @property
    def constructions(self) -> list[str]:
        return [*self.core, *self.breadth]

    def ceiling(self, construction: str) -> str:
        return FULL if self.shared_full else construction

    def curve_doses(self, construction: str) -> list:
        own = self.core_doses if construction in self.core else self.breadth_doses
        return [*own, "all"] if self.shared_full and "all" not in own else list(own)

    def cells(self, spark: SparkSession) -> DataFrame:
        """construction, dose, is_all, dose_num; no cell twice."""
        pairs = [(c, str(d)) for c in self.core for d in self.core_doses] + [(c, str(d)) for c in self.breadth for d in self.breadth_doses]
        pairs += [(FULL, "all")] if self.shared_full else []
        rows = spark.createDataFrame(list(dict.fromkeys(pairs)), "construction string, dose string")
        return rows.select("construction", "dose", (F.lower("dose") == "all").alias("is_all"), F.col("dose").try_cast("int").alias("dose_num"))

    def runs(self, spark: SparkSession, drop_dose: str | None = None) -> DataFrame:
        cells = self.cells(spark)
        if drop_dose is not None:
            cells = cells.where(F.col("dose") != str(drop_dose))
        return cells.crossJoin(spark.createDataFrame([(s,) for s in self.seeds], "seed int"))


def definitions(spark: SparkSession, config: dict, constructions: list[str]) -> DataFrame:
    """construction, definition: its name and example from a configuration of constructions; its code where that has none."""
    rows = []
    for code in constructions:
        entry = config.get(code) or {}
        name, example = entry.get("name", code), entry.get("example", "")
        rows.append((code, f'{name}. Example: "{example}"' if example else name))
    return spark.createDataFrame(rows, "construction string, definition string")


def load_config(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as stream:
        out = yaml.safe_load(stream)
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no mapping")
    return out


def resolve_path(config_path: str | Path, relative: str) -> Path:
    """Relative to the configuration folder's parent; absolute paths pass through."""
    p = Path(relative)
    return p if p.is_absolute() else Path(config_path).resolve().parent.parent / p
