"""gossamer: web-corpus and graph analytics as PySpark DataFrame plans."""
