"""Text-sensitivity analysis and training-data preparation on Spark."""
