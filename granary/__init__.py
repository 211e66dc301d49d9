"""granary: evidence and catalogue analytics as PySpark DataFrame transforms."""
