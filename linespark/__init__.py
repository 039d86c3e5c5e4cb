"""Assembly-line analytics as Spark DataFrame jobs."""
