"""tillscan: receipt analytics expressed as PySpark DataFrame plans."""
