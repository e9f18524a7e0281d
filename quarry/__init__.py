"""Entity intelligence and corpus preparation on PySpark."""
