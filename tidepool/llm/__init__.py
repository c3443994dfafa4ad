"""Training-data operators. Nothing else in tidepool imports this subpackage."""
