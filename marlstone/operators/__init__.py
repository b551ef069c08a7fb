"""Operators of the factor graph, each a function from columns to a column."""
