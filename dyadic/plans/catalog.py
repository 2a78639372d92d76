"""Imports every query module so their queries register."""

from dyadic.plans import table_queries, score_queries, kernel_queries, importance_queries, model_queries, fit_queries, io_queries, gibbs_queries  # noqa: F401
