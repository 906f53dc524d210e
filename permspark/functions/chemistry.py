"""Ionisation, distribution and absorption formulas as Column expressions.

Permeabilities are in 1e-6 cm/s, effective permeabilities in 1e-4 cm/s, flows in L/h, times in minutes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from permspark.functions.scalar import as_col, log10, ratio


@dataclass(frozen=True)
class Species:
    """Physiology needed by the absorption chain."""

    name: str
    residence_min: float
    radius_cm: float
    area_m2: float
    villous_flow: float
    body_kg: float


# Published small-intestine physiology and regression constants.
HUMAN = Species("human", 199.2, 1.75, 0.66, 18.0, 70.0)
RAT = Species("rat", 88.0, 0.18, 71.0 / 100.0**2, 0.65, 0.25)
PEFF_SLOPE = 0.4926
PEFF_OFFSET = -0.1454
RAT_SHIFT = 0.1815
RAT_SCALE = 1.039
COMPARTMENTS = 7
LIVER_TO_GUT = 100.0
INTESTINAL_TRANSIT = 0.5
CHARGED_ALPHA = 0.001

SPECIES = {s.name: s for s in (HUMAN, RAT)}


def _unionised(pka_list, ph: Column, sign: int) -> Column:
    """Product over sites of the un-ionised share; no sites gives 1."""
    sites = F.coalesce(
        F.transform(F.split(as_col(pka_list).cast("string"), ","), lambda s: s.try_cast("double")),
        F.array().cast("array<double>"),
    )
    known = F.filter(sites, lambda s: s.isNotNull())

    def step(acc, pka):
        return acc * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (pka - ph) * sign)))

    return F.aggregate(known, F.lit(1.0), step)


def ion_fractions(pka_acid, pka_base, ph) -> Column:
    """Struct of neutral / charged / negative / positive / zwitter fractions.

    Each site ionises independently by Henderson-Hasselbalch; the pKa columns may be numbers or
    comma-separated lists, NULL meaning that the molecule has no such site.
    """
    ph = as_col(ph).cast("double") if not isinstance(ph, (int, float)) else F.lit(float(ph))
    acid = _unionised(pka_acid, ph, 1)
    base = _unionised(pka_base, ph, -1)
    return F.struct(
        (acid * base).alias("fraction_neutral"),
        (F.lit(1.0) - acid * base).alias("fraction_charged"),
        ((F.lit(1.0) - acid) * base).alias("fraction_negative"),
        (acid * (F.lit(1.0) - base)).alias("fraction_positive"),
        ((F.lit(1.0) - acid) * (F.lit(1.0) - base)).alias("fraction_zwitter"),
    )


def log_d(log_p, fraction_charged, alpha: float = CHARGED_ALPHA) -> Column:
    """log10 distribution coefficient; charged forms partition alpha times as well as neutral ones."""
    charged = as_col(fraction_charged)
    return as_col(log_p) + log10(F.lit(1.0) - charged + F.lit(alpha) * charged)


def effective_permeability(pab, species: Species = HUMAN) -> Column:
    human = F.pow(F.lit(10.0), F.lit(PEFF_SLOPE) * log10(pab) + F.lit(PEFF_OFFSET))
    return human if species.name == "human" else human_to_rat(human)


def human_to_rat(peff) -> Column:
    return (as_col(peff) + F.lit(RAT_SHIFT)) / F.lit(RAT_SCALE) / F.lit(10.0)


def absorption_factor(species: Species) -> float:
    return 2 * species.residence_min / species.radius_cm / COMPARTMENTS * 60 / 1e4


def fraction_absorbed(peff, species: Species = HUMAN) -> Column:
    return F.lit(1.0) - F.pow(
        F.lit(1.0) + F.lit(absorption_factor(species)) * as_col(peff), F.lit(float(-COMPARTMENTS))
    )


def permeability_clearance(peff, species: Species = HUMAN) -> Column:
    return as_col(peff) * F.lit(species.area_m2 * 1000 / 1e4 / 100 * 3600)


def gut_flow(clearance, species: Species = HUMAN) -> Column:
    c = as_col(clearance)
    return ratio(F.lit(species.villous_flow) * c, F.lit(species.villous_flow) + c)


def fraction_gut(flow, free_fraction, gut_clearance, transit: float = INTESTINAL_TRANSIT) -> Column:
    q = as_col(flow)
    return ratio(q, q + as_col(free_fraction) * as_col(gut_clearance)) * ratio(q, q + F.lit(transit))


def fraction_hepatic(liver_flow, clearance, free_fraction, blood_to_plasma, restrictive: bool = True) -> Column:
    """First-pass availability; non-restrictive clearance is not limited by the unbound share."""
    fu = as_col(free_fraction)
    cl = as_col(clearance) if restrictive else ratio(clearance, fu)
    q = as_col(liver_flow)
    return ratio(q, q + ratio(cl * fu, blood_to_plasma))


def hepatic_to_gut_clearance(clearance_per_kg, species: Species = HUMAN) -> Column:
    return as_col(clearance_per_kg) * F.lit(species.body_kg) / F.lit(LIVER_TO_GUT)
