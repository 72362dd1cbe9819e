"""Operators over documents, pages and extracted layout tables, each a SELECT over named inputs."""

from . import checks, forms, html, layout, markup, outline, repair, report, trees, triage, upkeep
from .base import ALWAYS, BUILT, BY, OPERATORS, STORED, VIEWS

__all__ = ["ALWAYS", "BUILT", "BY", "OPERATORS", "STORED", "VIEWS", "checks", "forms", "html", "layout", "markup", "outline", "repair", "report", "trees", "triage", "upkeep"]
