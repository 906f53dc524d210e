"""From measured permeability to oral bioavailability, for any set of species in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from permspark.functions import chemistry as ch
from permspark.functions.scalar import log10
from permspark.operators.cleaning import expand_struct, measured_else_model
from permspark.operators.grouping import share_if


def ionisation(df: DataFrame, pka_acid: str, pka_base: str, log_p: str, ph=7.4) -> DataFrame:
    """Ion fractions and log10 distribution coefficient on every row."""
    out = expand_struct(df, ch.ion_fractions(pka_acid, pka_base, ph))
    return out.withColumn("log_d", ch.log_d(log_p, "fraction_charged"))


def absorption_chain(
    df: DataFrame, keep: list[str], measured: str, modelled: str, inputs: dict[str, dict[str, Column]]
) -> DataFrame:
    """One row per input row and species with the whole chain up to bioavailability.

    `inputs[species]` gives the columns free_fraction, clearance (L/h/kg), liver_flow (L/h/kg) and
    blood_to_plasma. The permeability is the measured one where there is one, else the model's.
    """
    pick = measured_else_model(measured, modelled)
    base = df.withColumns({"__pab": pick["value"], "pab_source": pick["source"]})
    layers: list[dict[str, Column]] = [{}, {}, {}, {}]
    for name, x in inputs.items():
        sp = ch.SPECIES[name]
        c = {k: F.col(f"__{k}_{name}") for k in ("peff", "clp", "q", "fgut", "fabs", "fhep")}
        layers[0][f"__peff_{name}"] = ch.effective_permeability("__pab", sp)
        layers[1][f"__clp_{name}"] = ch.permeability_clearance(c["peff"], sp)
        layers[1][f"__fabs_{name}"] = ch.fraction_absorbed(c["peff"], sp)
        layers[1][f"__fhep_{name}"] = ch.fraction_hepatic(
            x["liver_flow"], x["clearance"], x["free_fraction"], x["blood_to_plasma"]
        )
        layers[2][f"__q_{name}"] = ch.gut_flow(c["clp"], sp)
        layers[3][f"__fgut_{name}"] = ch.fraction_gut(
            c["q"], x["free_fraction"], ch.hepatic_to_gut_clearance(x["clearance"], sp)
        )
    for layer in layers:
        base = base.withColumns(layer)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("species"),
                F.col(f"__peff_{name}").alias("peff"),
                F.col(f"__q_{name}").alias("gut_flow"),
                F.col(f"__fabs_{name}").alias("f_abs"),
                F.col(f"__fgut_{name}").alias("f_gut"),
                F.col(f"__fhep_{name}").alias("f_hep"),
                (F.col(f"__fabs_{name}") * F.col(f"__fgut_{name}") * F.col(f"__fhep_{name}")).alias("f_bio"),
            )
            for name in inputs
        ]
    )
    return base.select(*keep, "pab_source", F.inline(rows))


def threshold_shares(df: DataFrame, pab: str, thresholds: dict[str, float], keys=()) -> DataFrame:
    """Count and share of entities below each permeability threshold."""
    known = df.where(F.col(pab).isNotNull())
    aggs = [F.count("*").alias("n")]
    for name, t in thresholds.items():
        low = F.col(pab) < F.lit(t)
        aggs += [F.sum(low.cast("bigint")).alias(f"n_{name}"), share_if(low).alias(f"share_{name}")]
    return known.groupBy(*keys).agg(*aggs)


def geometric_permeability(df: DataFrame, entity: str, value: Column) -> DataFrame:
    return df.groupBy(entity).agg(F.pow(F.lit(10.0), F.avg(log10(value))).alias("pab"))
