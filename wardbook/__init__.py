"""wardbook: clinical-operations data work as Spark DataFrame jobs."""
