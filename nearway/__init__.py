"""nearway: road-network analytics and corpus operators on PySpark."""
