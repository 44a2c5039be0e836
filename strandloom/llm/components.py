"""Connected components, as the graph of windows has them: hot centres are dealt out, rounds are stored."""

from strandloom.plans.components import components

__all__ = ["components"]
