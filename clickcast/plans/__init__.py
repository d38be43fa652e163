"""Composite plans (training features, scoring features, submission) and the
registry of named queries with their SQL oracles."""
