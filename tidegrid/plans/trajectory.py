"""The staged pipeline: readings to onset-anchored, fixed-step trajectories, as one lazy plan per stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carry, clean, flags, grid, onset
from ..session import materialise
from ..sources.tables import epoch, table

HOUR = 3600.0
CONCEPTS = [
    "heart_rate", "sbp", "dbp", "map", "respiratory_rate", "spo2", "temp_c", "tidal_volume", "fio2", "peep", "arterial_co2_pressure", "creatinine", "glucose", "hemoglobin", "lactate", "ph_arterial", "platelets",
    "potassium", "sodium", "wbc",
]


@dataclass
class Config:
    """Parameters of the pipeline; hold times in hours, bounds as (lowest, highest) plausible value."""

    step_h: float = 4.0
    before_h: float = 24.0
    after_h: float = 72.0
    concepts: list[str] = field(default_factory=lambda: list(CONCEPTS))
    # Hours for which the blueprint holds a reading
    hold_h: dict[str, float] = field(default_factory=lambda: {"heart_rate": 2, "sbp": 2, "dbp": 2, "map": 2, "respiratory_rate": 2, "spo2": 2, "temp_c": 6, "tidal_volume": 8, "fio2": 12, "peep": 12, **dict.fromkeys(["arterial_co2_pressure", "lactate", "ph_arterial"], 8), **dict.fromkeys(["creatinine", "hemoglobin", "platelets", "wbc"], 28), **dict.fromkeys(["potassium", "sodium", "glucose"], 14)})
    # The plausible ranges of the blueprint for these concepts
    bounds: dict[str, tuple[float | None, float | None]] = field(
        default_factory=lambda: {"heart_rate": (None, 250), "sbp": (None, 300), "dbp": (0, 200), "map": (0, 200), "respiratory_rate": (None, 80), "creatinine": (None, 150), "potassium": (1, 15), "glucose": (1, 1000)}
    )


@dataclass
class Trajectories:
    """Each stage is a method that returns a DataFrame. Anchors and grid bounds, one row per entity and needed by several stages, are
    written once when first asked for; everything else runs with an action."""

    spark: SparkSession
    folder: str
    config: Config = field(default_factory=Config)
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def _once(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = materialise(df, name)
        return self._kept[name]

    def readings(self) -> DataFrame:
        """Usable numeric readings of chart and laboratory (stay_id, t, concept, v, lab, itemid, st, row_id)."""
        items = table(self.spark, self.folder, "d_items").where("kind IN ('measured', 'setting')").select("itemid", "concept")
        names = {"chartevents": "charttime", "labs_le": "timestp"}
        parts = [
            table(self.spark, self.folder, n).where(f"stay_id IS NOT NULL AND {t} IS NOT NULL AND valuenum IS NOT NULL AND NOT isnan(valuenum)").select("stay_id", F.col(t).alias("t"), "itemid", F.col("valuenum").alias("v"), F.lit(k).alias("lab"), F.coalesce("storetime", F.lit(-1.0)).alias("st"), "row_id")
            for k, (n, t) in enumerate(names.items())
        ]
        return parts[0].unionByName(parts[1]).join(items, "itemid").select("stay_id", "t", "concept", "v", "lab", "itemid", "st", "row_id")

    def pivoted(self, readings: DataFrame) -> DataFrame:
        """One row per stay and time, a column per concept; of several values the laboratory's, of the larger item, stored later, wins."""
        best = F.max_by("v", F.struct("lab", "itemid", "st", "row_id"))
        return readings.where(F.col("concept").isin(self.config.concepts)).groupBy("stay_id", "t").pivot("concept", self.config.concepts).agg(best)

    def wide(self) -> DataFrame:
        return self.pivoted(self.readings())

    def near(self) -> DataFrame:
        """Readings of the concepts around the anchor: what the stages after it work on."""
        c = self.config
        return grid.around_anchor(self.readings().where(F.col("concept").isin(c.concepts)), self.anchors(), "stay_id", "t", "onset_time", c.before_h * HOUR, c.after_h * HOUR)

    def anchors(self) -> DataFrame:
        """(stay_id, onset_time) from antibiotic starts and cultures."""
        return self._once("anchors", onset.first_anchor(table(self.spark, self.folder, "abx"), table(self.spark, self.folder, "bacterio"), "stay_id", "abx_id", "starttime", "bact_id", "charttime"))

    def cleaned(self) -> DataFrame:
        """Wide rows around the anchor with impossible values removed, fractions as percent, saturation clamped, values held."""
        c = self.config
        near = clean.out_of_bounds_to_null(self.pivoted(self.near()), {k: b for k, b in c.bounds.items() if k in c.concepts})
        fixes = {"spo2": clean.clamp(F.col("spo2"), 150.0, 100.0), "fio2": clean.fraction_to_percent(F.col("fio2"))}
        near = near.withColumns({k: v for k, v in fixes.items() if k in c.concepts})
        return carry.hold_values(near, "stay_id", "t", {k: h * HOUR for k, h in c.hold_h.items() if k in c.concepts})

    def bounds(self) -> DataFrame:
        c = self.config
        return self._once("bounds", grid.grid_bounds(self.near(), "stay_id", "t", "onset_time", c.before_h * HOUR, c.after_h * HOUR, c.step_h * HOUR))

    def streams(self) -> list[DataFrame]:
        """What other records give to the cells (stay_id, timestep, ...): intakes, rates, treatments."""
        b, step, on = self.bounds(), self.config.step_h * HOUR, ["stay_id", "timestep"]
        fluid = table(self.spark, self.folder, "fluid").where("stay_id IS NOT NULL AND starttime IS NOT NULL AND endtime IS NOT NULL").select("stay_id", "starttime", "endtime", "amount", "rate")
        each = grid.overlapped_cells(fluid, b, "stay_id", "starttime", "endtime", step, closed_start=False).groupBy(*on).agg(F.sum("amount").alias("fluid_step"), F.median(F.nanvl("rate", F.lit(None))).alias("rate_median"), F.max(F.nanvl("rate", F.lit(None))).alias("rate_max"))
        total = grid.running_before(fluid, b, "stay_id", "endtime", "amount", step).withColumnRenamed("total", "fluid_total")
        drugs = table(self.spark, self.folder, "abx").where("stay_id IS NOT NULL AND stoptime >= starttime").select("stay_id", "starttime", "stoptime", F.lower(F.trim("drug")).alias("drug"))
        given = grid.overlapped_cells(drugs, b, "stay_id", "starttime", "stoptime", step, closed_start=True).groupBy(*on).agg(F.count_distinct("drug").alias("n_drugs"))
        return [each, total, given]

    def fixed(self) -> DataFrame:
        """Trajectories (stay_id, timestep, timestamp, a mean per concept, fluid_step, fluid_total, rate_median, rate_max, n_drugs, hours_in):
        the cells of the grid joined with their streams and with what is known of the stay."""
        c, step = self.config, self.config.step_h * HOUR
        b = self.bounds()
        out = grid.grid_cells(b, "stay_id", step)
        for part in [grid.cell_means(self.cleaned(), b, "stay_id", "t", c.concepts, step), *self.streams()]:
            out = out.join(part, ["stay_id", "timestep"], "left")
        stay = table(self.spark, self.folder, "icustays").groupBy("stay_id").agg(F.min(epoch("intime")).alias("_in"))
        out = out.join(stay, "stay_id", "left").withColumn("hours_in", (F.col("timestamp") - F.col("_in")) / HOUR).drop("_in")
        return out.fillna(0, ["fluid_step", "fluid_total", "rate_median", "rate_max", "n_drugs"])

    def flagged(self, concept: str = "map", below: float = 75.0, fluid: float = 500.0) -> DataFrame:
        """Trajectories with the rolling fluid sum of three steps and the first step at which both conditions hold."""
        t = self.fixed().withColumn("fluid_rolling", flags.rolling_sum("stay_id", "timestep", "fluid_step", 3))
        return flags.first_event(t, "stay_id", "timestep", (F.col("fluid_rolling") >= fluid) & (F.col(concept) < below), "event_flag")
