"""Whole jobs built from the operators: clean table, feature store, forecast, replenishment, upload."""
