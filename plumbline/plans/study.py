"""A causal study end to end: identify on the graph, estimate on the table, refute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.operators import effects, refuters
from plumbline.operators.graphs import CausalGraph


@dataclass
class Study:
    """Columns of ``df`` carry the names of the graph's variables."""

    df: DataFrame
    graph: CausalGraph
    treatment: str
    outcome: str

    def identify(self) -> list[str]:
        found = self.graph.backdoor(self.treatment, self.outcome)
        if found is None:
            raise ValueError("treatment or outcome is not in the graph")
        if missing := found - set(self.df.columns):
            raise ValueError(f"the adjustment set is not in the table: {sorted(missing)}")
        return sorted(found)

    def estimate(self, keys: tuple = ()) -> DataFrame:
        adjust = self.identify()
        if not adjust:
            return effects.difference_in_means(self.df, self.treatment, self.outcome, keys)
        return effects.ols_adjusted(self.df, self.treatment, self.outcome, adjust, keys)

    def refute(self, unit: str, tolerance: float) -> DataFrame:
        """A row for each refutation test of the unadjusted effect."""
        ate = effects.difference_in_means(self.df, self.treatment, self.outcome).first()["ate"]
        args = (self.df, self.treatment, self.outcome, ate, unit)
        return refuters.placebo(self.df, self.outcome, ate, unit, tolerance).unionByName(refuters.random_common_cause(*args)).unionByName(refuters.subset_validation(*args)).unionByName(refuters.bootstrap(*args))
