"""PySpark operators for finding money-mule behaviour in bank ledgers."""
