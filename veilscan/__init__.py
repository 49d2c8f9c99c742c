"""Secret scanning over tables of text, as Spark plans."""

from .options import ScanOptions
from .rules import RuleSet

__all__ = ["RuleSet", "ScanOptions"]
