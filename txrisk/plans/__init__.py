"""Registered queries (one module per area); importing this package registers them."""

from txrisk.plans import checks, discovery, eda, evaluation, history, models, rule_shap, streaming, text  # noqa: F401
