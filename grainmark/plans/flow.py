"""Composed pipelines: named steps run in order over one table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.columns import frame
from ..operators import advise, clean, contracts, features, impute, outliers, profile, quality, relate

GOALS = {
    "inspect": ["analyze", "impute", "deduplicate", "outliers", "readiness", "relationships"],
    "clean": ["analyze", "deduplicate", "impute", "validate"],
    "prepare": ["analyze", "deduplicate", "impute", "engineer", "prepare"],
    "full": ["analyze", "validate", "deduplicate", "impute", "outliers", "quality", "relationships", "readiness", "target", "prepare"],
    "automl": ["analyze", "deduplicate", "impute", "target", "automl"],
}


@dataclass
class Run:
    df: DataFrame
    results: dict[str, DataFrame] = field(default_factory=dict)
    log: list[tuple[str, float, str, str]] = field(default_factory=list)

    def log_table(self) -> DataFrame:
        return frame(self.df.sparkSession, self.log, "step string, seconds double, status string, detail string")


class Flow:
    """Steps by name; a step may replace the working table, add a result, or both.

    A step that fails is logged and the next one goes on with the table as it was.
    """

    def __init__(self, target: str | None = None, key: list[str] | None = None, impute_strategy: str = "median"):
        self.target, self.key, self.strategy = target, key or [], impute_strategy
        self.steps: dict[str, Callable[[Run], None]] = {
            "analyze": lambda r: self._add(r, "analyze", profile.full_report(r.df)),
            "impute": self._impute,
            "deduplicate": self._deduplicate,
            "outliers": lambda r: self._add(r, "outliers", outliers.outlier_report(r.df)),
            "readiness": lambda r: self._add(r, "readiness", advise.ml_readiness(r.df)),
            "relationships": lambda r: self._add(r, "relationships", relate.detect_relationships(r.df)),
            "validate": lambda r: self._add(r, "validate", contracts.evaluate_contracts(r.df)),
            "quality": lambda r: self._add(r, "quality", quality.score_quality(r.df).scores()),
            "target": lambda r: self._add(r, "target", advise.detect_target(r.df)),
            "engineer": self._engineer,
            "prepare": self._prepare,
            "automl": self._automl,
        }

    @staticmethod
    def _add(r: Run, name: str, df: DataFrame) -> None:
        r.results[name] = df

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """A user step: a function of the table that returns the new table."""

        def step(r: Run) -> None:
            r.df = r.df.transform(fn)

        self.steps[name] = step

    def _impute(self, r: Run) -> None:
        holes = clean.columns_with_nulls(r.df)
        if holes:
            before = r.df
            r.df = impute.impute_simple(r.df, self.strategy)
            r.results["impute"] = impute.imputation_audit(before, r.df)

    def _deduplicate(self, r: Run) -> None:
        r.results["deduplicate"] = profile.duplicate_rows(r.df)
        r.df = clean.remove_duplicates(r.df)

    def _engineer(self, r: Run) -> None:
        r.df = features.engineer_features(r.df)

    def _prepare(self, r: Run) -> None:
        r.df, r.results["prepare"] = features.prepare_for_ml(r.df)

    def _automl(self, r: Run) -> None:
        from ..operators import automl

        target = self.target or r.results["target"].first()["recommended"]
        r.results["automl"] = automl.run_automl(r.df, target, self.key).board

    def run(self, df: DataFrame, goal: str | list[str]) -> Run:
        r = Run(df)
        for name in GOALS[goal] if isinstance(goal, str) else goal:
            t0 = time.time()
            before = r.df
            try:
                self.steps[name](r)
                if r.df is not before:
                    r.df = scratch.materialise(r.df)  # one write instead of a re-run per later step
                if name in r.results:
                    r.results[name] = scratch.materialise(r.results[name])
                r.log.append((name, round(time.time() - t0, 3), "ok", ""))
            except Exception as e:
                r.df = before
                r.results.pop(name, None)
                r.log.append((name, round(time.time() - t0, 3), "failed", str(e)[:200]))
        return r


def inspect(df: DataFrame, **options) -> Run:
    return Flow(**options).run(df, "inspect")


def summary(r: Run) -> DataFrame:
    """One row: steps run, steps failed, rows and columns at the end."""
    log = r.log_table().agg(F.count(F.lit(1)).alias("n_steps"), F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"))
    n = r.df.count()
    return log.withColumn("n_rows", F.lit(n)).withColumn("n_columns", F.lit(len(r.df.columns)))
