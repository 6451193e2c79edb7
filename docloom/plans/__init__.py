"""The queries: ``catalogue`` holds the registry and the larger ones, ``rules`` those of single operators."""

from . import catalogue, rules

__all__ = ["catalogue", "rules"]
