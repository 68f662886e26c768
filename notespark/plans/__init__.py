"""Compositions of operators: knowledge extraction, selection, assembly and reports."""
