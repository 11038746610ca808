"""Multi-job procedures: nested evaluation, external comparison, training."""
