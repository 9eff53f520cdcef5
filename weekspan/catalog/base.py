"""Registration of checked queries: a Spark callable, its output columns and, where possible, DuckDB SQL.

Output columns are given as ``name:kind`` words; both sides are cast the same way, so only values can differ.
Kinds: i integer, d double rounded to 6 places, f double rounded to 3 places, s text, b boolean as 0/1, t timestamp
as text, y date as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, tuple] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql.strip())


def with_ctes(body: str, needs: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in CTES[name][0]:
            visit(n)
        ordered.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} as materialized ({CTES[n][1]})" for n in ordered]
    parts.append(f"result_rows as ({body.strip()})")
    return "with " + ",\n".join(parts)


def _columns(spec: str | list[str]) -> list[tuple[str, str]]:
    words = spec.split() if isinstance(spec, str) else spec
    return [tuple(w.rsplit(":", 1)) for w in words]


def _quoted(name: str) -> str:
    return '"' + name + '"'


SQL_CASTS = {
    "i": "cast({0} as bigint)",
    "b": "cast({0} as bigint)",
    "d": "round(cast({0} as double), 6) + 0.0",
    "f": "round(cast({0} as double), 3) + 0.0",
    "s": "cast({0} as varchar)",
    "t": "strftime(cast({0} as timestamp), '%Y-%m-%d %H:%M:%S.%f')",
    "y": "strftime(cast({0} as date), '%Y-%m-%d')",
}


SPARK_CASTS = {
    "i": "cast({0} as bigint)",
    "b": "cast(cast({0} as int) as bigint)",
    "d": "round(cast({0} as double), 6)",
    "f": "round(cast({0} as double), 3)",
    "s": "cast({0} as string)",
    "t": "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
    "y": "date_format({0}, 'yyyy-MM-dd')",
}


def present(df: DataFrame, spec: str | list[str]) -> DataFrame:
    return df.selectExpr(*[f"{SPARK_CASTS[k].format(f'`{n}`')} as `{n}`" for n, k in _columns(spec)])


def query(name: str, spec: str | list[str] | None = None, sql: str | None = None, needs: tuple[str, ...] | str = ()):
    """Register a query; ``sql`` is the body of the oracle and ``needs`` the shared sub-selects it uses."""
    if isinstance(needs, str):
        needs = tuple(needs.split())

    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (lambda spark, folder: present(run(spark, folder), spec)) if spec else run
        if sql is not None:
            ORACLES[name] = (sql, needs, spec)
        return run

    return register


def oracle_texts() -> dict[str, str]:
    """Complete SQL of every registered oracle."""
    texts = {}
    for name, (sql, needs, spec) in ORACLES.items():
        chosen = ", ".join(f"{SQL_CASTS[k].format(_quoted(n))} as {_quoted(n)}" for n, k in _columns(spec))
        texts[name] = f"{with_ctes(sql, needs)}\nselect {chosen} from result_rows"
    return texts
