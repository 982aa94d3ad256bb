"""Queries over the test tables, one or more per operator, with the SQL that checks them."""

from importlib import import_module

MODULES = [import_module(f"suite.{name}") for name in ("corpus", "spans", "salience", "embeddings", "ontology", "evaluation")]
