"""Statistics from Spark aggregates; only small matrices and result rows reach the driver."""
