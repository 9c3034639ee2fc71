"""Queries over the supplied star-schema tables, each with its SQL counterpart."""
