"""Small-area estimates from large, uneven surveys, on Spark."""
