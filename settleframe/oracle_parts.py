"""Pieces of DuckDB SQL that several oracles use: rounding, and p-values by series."""

from __future__ import annotations


def R(x: str) -> str:  # noqa: N802
    return f"round(cast({x} as double), 6) + 0.0"


def B(x: str) -> str:  # noqa: N802
    return f"cast({x} as bigint)"


def _beta(a: str, b: str) -> str:
    return f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"


def two_sided(z: str) -> str:
    """Normal two-sided p of the column z by a series of positive terms: 1 - erf(|z| / sqrt 2)."""
    term = f"exp(2*k*ln(2) + lgamma(k + 1) - lgamma(2*k + 2) + (2*k + 1)*ln(abs({z})/sqrt(2)))"
    erf = f"2/sqrt(pi())*exp(-{z}*{z}/2)*list_sum(list_transform(range(0, 250), lambda k: {term}))"
    return f"(case when abs({z}) < 1e-12 then 1.0 when abs({z}) > 9 then 0.0 else 1 - {erf} end)"


def upper(z: str) -> str:
    return f"(case when {z} >= 0 then {two_sided(z)}/2 else 1 - {two_sided(z)}/2 end)"


def student(t: str, df: str) -> str:
    """Two-sided p of Student's t from the columns t and df: the incomplete beta function by a series of positive terms."""
    y, a = f"({t}*{t}/({df} + {t}*{t}))", f"({df}/2)"
    head = f"exp(0.5*ln({y}) + {a}*ln(1 - {y}) - ln(0.5) - {_beta('0.5', a)})"
    term = f"exp({_beta('1.5', '(k + 1)')} - {_beta(f'(0.5 + {a})', '(k + 1)')} + (k + 1)*ln({y}))"
    tail = f"1 - {head}*(1 + list_sum(list_transform(range(0, 500), lambda k: {term})))"
    return f"(case when abs({t}) < 1e-12 then 1.0 when abs({t}) > 12 and {df} > 30 then 0.0 else {tail} end)"


def exact(sql: str) -> str:
    """The same SQL without rounding, for use inside other SQL."""
    return sql.replace("round(cast(", "(cast(").replace(" as double), 6) + 0.0", " as double))")
