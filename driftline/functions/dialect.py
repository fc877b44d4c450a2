"""SQL expressions that the operators are made of, for Spark and for a checking engine (DuckDB).

Constants are written with an exponent, so that both engines read them as doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

EPS = "1e-9"


@dataclass(frozen=True)
class Dialect:
    name: str

    def quantile(self, x: str, q: float, where: str = "") -> str:
        f = "percentile" if self.name == "spark" else "quantile_cont"
        return f"{f}({x}, {q})" + (f" FILTER (WHERE {where})" if where else "")

    def numbers(self, source: str, upto: str, alias: str) -> str:
        """FROM clause: rows of source, each with the numbers 0..upto."""
        if self.name == "spark":
            return f"{source} LATERAL VIEW explode(sequence(0, {upto})) numbers_ AS {alias}"
        return f"(SELECT *, unnest(range(0, {upto} + 1)) AS {alias} FROM {source})"

    def div(self, a: str, b: str) -> str:
        return f"({a}) div ({b})" if self.name == "spark" else f"({a}) // ({b})"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def libm_ln(values: Iterable[float]) -> list[float]:
    """The C library's logarithm, as the checking engine has it; Java's may differ in the last digit. NaN where there is none."""
    return [math.log(v) if v > 0 else math.nan for v in values]


def log(x: str) -> str:
    return f"ln(greatest({x}, {EPS}))"


def log_ratio(a: str, b: str) -> str:
    return log(f"(({a}) + {EPS}) / (({b}) + {EPS})")


def jeffreys(hits: str, n: str) -> str:
    """Logit of (hits + 1/2) / (n + 1), clipped; null where n is not positive."""
    p = f"least(greatest((({hits}) + 0.5e0) / (({n}) + 1e0), {EPS}), 1e0 - {EPS})"
    return f"CASE WHEN ({n}) > 0 THEN {log(f'({p}) / (1e0 - {p})')} END"


def fisher(x: str) -> str:
    c = f"least(greatest({x}, -1e0 + {EPS}), 1e0 - {EPS})"
    return f"(0.5e0 * ln((1e0 + {c}) / (1e0 - {c})))"


def after(c: str) -> str:
    return f"max(CASE WHEN period = 1 THEN {c} END)"


def before(c: str) -> str:
    return f"max(CASE WHEN period = 0 THEN {c} END)"


def delta(c: str) -> str:
    return f"{after(c)} - {before(c)}"


def rounded(columns: dict[str, str], digits: int = 6) -> str:
    """SELECT list of name: expression, rounded; a zero has no sign."""
    return ", ".join(f"round({e}, {digits}) + 0e0 AS {n}" for n, e in columns.items())
