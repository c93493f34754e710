"""wardlight: hospital analytics expressed as PySpark DataFrame operators."""
