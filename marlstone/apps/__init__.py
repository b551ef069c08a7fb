"""Factor analysis, backtests, optimisation, sensitivity and worker transforms."""
