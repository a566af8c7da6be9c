"""Connected components, as the catalog has them."""

from mediaquarry.operators.components import connected_components

__all__ = ["connected_components"]
