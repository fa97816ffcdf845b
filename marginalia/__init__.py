"""An audit engine for scored interventions on Spark DataFrames."""
