"""Effect-table and score-table analytics as plain Spark DataFrame jobs."""
