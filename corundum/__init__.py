"""A Spark-native analytics engine with the reach of a small embedded SQL database."""

from .session import Engine, Prepared
from .tables import Conflict, ConstraintViolation, DmlResult

__version__ = "0.1.0"
__all__ = ["Conflict", "ConstraintViolation", "DmlResult", "Engine", "Prepared", "__version__"]
