"""Whole audits composed from the operators, and the registered queries with their SQL oracles."""
