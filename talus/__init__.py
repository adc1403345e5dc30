"""talus: point-cloud, terrain and corpus analytics on PySpark DataFrames."""
