"""Set-valued segment analytics on Spark."""
