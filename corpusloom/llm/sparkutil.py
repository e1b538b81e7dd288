"""Session helpers of the operators: checkpoints in the shared folder, and free column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.session import cut  # noqa: F401


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k, new = 0, f"_{name}"
        while new.lower() in taken:
            k += 1
            new = f"_{name}{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def without(df: DataFrame, names) -> DataFrame:
    """df without columns of these names: those of an operator's results take their place."""
    wanted = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in wanted))


def aside(df: DataFrame, names) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns of these names renamed, and the function that renames them back in a result."""
    wanted = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in wanted]
    hidden = dict(zip(clash, fresh(df, *(f"aside_{c}" for c in clash))))
    back = {new: c for c, new in hidden.items()}

    def restore(out: DataFrame) -> DataFrame:
        return out.withColumnsRenamed({k: v for k, v in back.items() if k in out.columns})

    return df.withColumnsRenamed(hidden), restore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
