"""Multi-step plans: fit, forecast, validate, disease pipelines."""
