"""Assessment analytics on Spark: operators over tables that hold many assessments."""
