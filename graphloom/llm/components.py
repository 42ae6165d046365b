"""Connected components, as the near-duplicate join uses them."""

from ..operators.components import components, contracted, least_of_each

__all__ = ["components", "contracted", "least_of_each"]
