"""Short-range particle dynamics in a periodic box: settings, forces, steps and observables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import minimum_image, pair_energy, pair_force, squared_distance, wrap
from ..operators.aggregate import antisymmetric_scatter
from ..operators.joins import near_pairs
from ..sources.generators import box_side
from .fixpoint import cut


@dataclass(frozen=True)
class Settings:
    """Settings that follow from the number of particles; the defaults are fixed values."""

    particles: int
    cutoff: float = 3.0
    temperature: float = 0.722
    step: float = 0.064 / 4
    tolerance: float = 1.2

    @property
    def side(self) -> float:
        return box_side(self.particles)

    @property
    def usual_speed(self) -> float:
        return 1.13 * math.sqrt(self.temperature / 24)


def pair_terms(particles: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """(i, j, rd, fx, fy, fz) of the pairs closer than the cutoff; coinciding particles have no force."""
    a = particles.select(F.col("id").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    b = particles.select(F.col("id").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    rows = pairs.join(a, "i").join(b, "j")
    rows = rows.select("i", "j", *(minimum_image(F.col(f"{c}1") - F.col(f"{c}2"), settings.side).alias(f"d{c}") for c in "xyz"))
    rows = rows.withColumn("rd", squared_distance(F.col("dx"), F.col("dy"), F.col("dz"))).filter(F.col("rd") < settings.cutoff**2)
    push = F.coalesce(pair_force(F.col("rd")), F.lit(0.0))
    return rows.select("i", "j", "rd", *((F.col(f"d{c}") * push).alias(f"f{c}") for c in "xyz"))


def forces(particles: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """(id, fx, fy, fz) for every particle."""
    found = antisymmetric_scatter(pair_terms(particles, pairs, settings))
    return particles.select("id").join(found, "id", "left").select("id", *(F.coalesce(f"f{c}", F.lit(0.0)).alias(f"f{c}") for c in "xyz"))


def one_step(state: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """state (id, x, y, z, vh*, f*) a step on: move by vh + f and wrap, vh += f, new forces scaled by half the squared step, vh += f."""
    moved = state.select("id", *(wrap(F.col(c) + F.col(f"vh{c}") + F.col(f"f{c}"), settings.side).alias(c) for c in "xyz"), *((F.col(f"vh{c}") + F.col(f"f{c}")).alias(f"vh{c}") for c in "xyz"))
    scaled = forces(moved, pairs, settings).select("id", *((F.col(f"f{c}") * (settings.step**2 / 2)).alias(f"f{c}") for c in "xyz"))
    return moved.join(scaled, "id").select("id", *"xyz", *((F.col(f"vh{c}") + F.col(f"f{c}")).alias(f"vh{c}") for c in "xyz"), *(f"f{c}" for c in "xyz"))


def simulate(state: DataFrame, settings: Settings, steps: int, rebuild_every: int = 20, pairs: DataFrame | None = None) -> DataFrame:
    """state after so many steps; the list of near pairs, wider than the cutoff by the tolerance, is made anew every few."""
    for c in "xyz":
        if f"f{c}" not in state.columns:
            state = state.withColumn(f"f{c}", F.lit(0.0))
    for i in range(steps):
        if pairs is None or i and i % rebuild_every == 0:
            pairs = cut(near_pairs(state, settings.side, settings.tolerance * settings.cutoff))
        state = cut(one_step(state, pairs, settings)) if i + 1 < steps else one_step(state, pairs, settings)
    return state


def observables(state: DataFrame, settings: Settings) -> DataFrame:
    """One row (ekin, vel, fast): kinetic energy, the sum of speeds, and particles faster than the usual speed."""
    square = F.col("vhx") ** 2 + F.col("vhy") ** 2 + F.col("vhz") ** 2
    return state.agg((F.sum(square) / settings.step**2).alias("ekin"), (F.sum(F.sqrt(square)) / settings.step).alias("vel"), F.count_if(F.sqrt(square) > settings.usual_speed * settings.step).alias("fast"))


def report(state: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """One row (ek, epot, etot, temp, pres, vel, rp) of a state."""
    n = settings.particles
    terms = pair_terms(state, pairs, settings).agg(F.coalesce(F.sum(pair_energy(F.col("rd"))), F.lit(0.0)).alias("e"), F.coalesce(F.sum(F.col("rd") * pair_force(F.col("rd"))), F.lit(0.0)).alias("v"))
    rows = observables(state, settings).crossJoin(terms)  # one row each
    density = 0.83134
    ek, epot, temp = 24 * F.col("ekin"), 4 * F.col("e"), F.col("ekin") * (16 / (n - 1))
    return rows.select(ek.alias("ek"), epot.alias("epot"), (ek + epot).alias("etot"), temp.alias("temp"), (density * 16 * (F.col("ekin") - F.col("v")) / n).alias("pres"), (F.col("vel") / n).alias("vel"), (F.col("fast") / n * 100).alias("rp"))
