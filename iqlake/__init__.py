"""Analytics over labelled signal windows and model predictions, as Spark DataFrame queries."""
