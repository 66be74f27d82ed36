"""Grid, array and corpus operators expressed as Spark DataFrame plans."""
