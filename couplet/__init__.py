"""Entity-to-category coupling analytics expressed as Spark DataFrame jobs."""

from couplet.spec import CouplingSpec, Study, register_cells

__version__ = "0.1.0"

__all__ = ["CouplingSpec", "Study", "register_cells", "__version__"]
