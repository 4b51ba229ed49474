"""dunlin: loan-collections KPIs as Spark DataFrame operators."""

from .rules import DEFAULT, PRESETS, Rules
from .sources.periods import Periods
from .sources.tables import Tables

__all__ = ["DEFAULT", "PRESETS", "Periods", "Rules", "Tables"]
