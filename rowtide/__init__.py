"""Keep tables in step and watch over them, as plain DataFrame functions on Spark."""
