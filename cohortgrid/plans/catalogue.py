"""All queries of the library and the SQL they are held against."""

from . import calibration, matrix, models, nested, tables  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
