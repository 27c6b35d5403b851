"""Compositions of operators: end-to-end runs, group analysis, registered queries."""
