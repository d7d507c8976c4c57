"""Physicochemical column functions.

Sums over residues are written as count x weight, so that a property of a whole text is one
expression over at most 20 integer counts.
"""

from pyspark.sql import Column, functions as F

from seqloom import constants as K
from seqloom.functions.sequences import let


def residue_counts(s: Column) -> dict:
    return {a: F.length(s) - F.length(F.replace(s, F.lit(a), F.lit(""))) for a in K.RESIDUES}


def _weighted(counts: dict, table: dict) -> Column:
    total = F.lit(0.0)
    for a in K.RESIDUES:
        total = total + counts[a] * F.lit(float(table[a]))
    return total


def peptide_mass(s: Column, counts: dict = None) -> Column:
    counts = counts or residue_counts(s)
    water = (F.length(s) - 1) * F.lit(K.WATER)
    return F.when(F.length(s) > 0, _weighted(counts, K.MASS) - water).otherwise(0.0)


def normalize_unit(u: Column) -> Column:
    """Lower-case unit with both mu code points and 'micro' written as u, no spaces."""
    low = F.lower(F.trim(F.coalesce(u, F.lit(""))))
    for mark in ("μ", "µ", "micro", "碌"):
        low = F.replace(low, F.lit(mark), F.lit("u"))
    return F.replace(low, F.lit(" "), F.lit(""))


def to_micromolar(value: Column, unit: Column, mass: Column) -> Column:
    """Concentration in micromolar; null for non-positive values and unknown units.

    Takes the mass, so that a table computes it once per sequence and not once per record.
    """
    return micromolar_of(value, normalize_unit(unit), mass)


def micromolar_of(value: Column, u: Column, mass: Column) -> Column:
    """The conversion for an already normalised unit."""
    mass = F.nullif(mass, F.lit(0.0))
    return F.when(
        value > 0,
        F.when(u.isin(K.UNITS_UM), value)
        .when(u == "nm", value / 1000.0)
        .when(u == "mm", value * 1000.0)
        .when(u.isin(K.UNITS_UG_ML), value * 1000.0 / mass)
        .when(u == "mg/ml", value * 1000000.0 / mass),
    )


def hydrophobic_fraction(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, f"[^{K.HYDROPHOBIC}]", "")) / n)


def gravy(s: Column, counts: dict = None) -> Column:
    return F.when(F.length(s) > 0, _weighted(counts or residue_counts(s), K.KYTE_DOOLITTLE) / F.length(s))


def na4vss(s: Column, counts: dict = None) -> Column:
    total = _weighted(counts or residue_counts(s), K.AGGREGATION)
    return F.when(F.length(s) > 0, F.lit(100.0) * total / F.length(s))


def _end_pk(residue: Column, default: float, table: dict) -> Column:
    out = None
    for a, pk in table.items():
        out = F.when(residue == a, pk) if out is None else out.when(residue == a, pk)
    return out.otherwise(default)


def charge_terms(s: Column, counts: dict = None) -> Column:
    """What a charge needs: counts of the ionisable residues and the pK of both ends."""
    counts = counts or residue_counts(s)
    fields = [counts[a].alias(a) for a in [*K.PK_POSITIVE, *K.PK_NEGATIVE]]
    first, last = F.substr(s, F.lit(1), F.lit(1)), F.right(s, F.lit(1))
    return F.struct(
        *fields,
        _end_pk(first, K.PK_N_TERM, K.PK_N_TERM_BY_RESIDUE).alias("n_pk"),
        _end_pk(last, K.PK_C_TERM, K.PK_C_TERM_BY_RESIDUE).alias("c_pk"),
    )


def charge_at(terms: Column, ph) -> Column:
    ph = F.lit(float(ph)) if not isinstance(ph, Column) else ph

    def positive(pk):
        r = F.pow(F.lit(10.0), pk - ph)
        return r / (r + 1.0)

    def negative(pk):
        r = F.pow(F.lit(10.0), ph - pk)
        return r / (r + 1.0)

    total = positive(terms["n_pk"])
    for a, pk in K.PK_POSITIVE.items():
        total = total + terms[a] * positive(F.lit(pk))
    total = total - negative(terms["c_pk"])
    for a, pk in K.PK_NEGATIVE.items():
        total = total - terms[a] * negative(F.lit(pk))
    return total


def net_charge(s: Column, ph: float = 7.4) -> Column:
    return F.when(F.length(s) > 0, charge_at(charge_terms(s), ph))


def isoelectric_point_from(terms: Column) -> Column:
    """pH of zero charge by a fixed number of halvings, as a fold over a short literal array."""
    start = F.struct(
        F.lit(K.PI_START).alias("ph"), F.lit(K.PI_LOW).alias("lo"), F.lit(K.PI_HIGH).alias("hi")
    )

    def halve(acc, _):
        up = charge_at(terms, acc["ph"]) > 0
        lo = F.when(up, acc["ph"]).otherwise(acc["lo"])
        hi = F.when(up, acc["hi"]).otherwise(acc["ph"])
        return F.struct(((lo + hi) / 2).alias("ph"), lo.alias("lo"), hi.alias("hi"))

    steps = F.array(*[F.lit(i) for i in range(K.PI_STEPS)])
    return F.aggregate(steps, start, halve, lambda acc: acc["ph"])


def isoelectric_point(s: Column) -> Column:
    return F.when(F.length(s) > 0, let(charge_terms(s), isoelectric_point_from))


def hydrophobic_moment(s: Column, scale: dict = None, angle: float = 100.0) -> Column:
    """Length of the mean hydrophobicity vector; residue i points at i x angle, i from 0."""
    scale = scale or K.KYTE_DOOLITTLE
    table = F.array(*[F.lit(float(scale.get(chr(65 + i), 0.0))) for i in range(26)])
    values = F.transform(F.split(s, ""), lambda c: F.get(table, F.ascii(c) - 65))

    def length(h):
        def part(fn):
            terms = F.transform(h, lambda v, i: v * fn(F.radians(i * F.lit(angle))))
            return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

        return F.hypot(part(F.cos), part(F.sin))

    return F.when(F.length(s) > 0, let(values, length) / F.length(s))


def dipeptide_expected(a: Column, b: Column) -> Column:
    """Codon-expected share of an adjacent residue pair."""
    table = F.create_map(*[F.lit(x) for kv in K.CODONS.items() for x in kv])
    return F.element_at(table, a) * F.element_at(table, b) / F.lit(float(K.SENSE_CODONS**2))
