"""A small graph-pattern query language, compiled to DataFrame plans."""

from graphloom.pattern.parser import PatternError, parse
from graphloom.pattern.planner import run

__all__ = ["PatternError", "parse", "run"]
