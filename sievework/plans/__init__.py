"""Compositions of operators: the registered queries, their SQL twins and the extraction pipeline."""
