"""Container analytics on Spark: sorted rows, scored sets, bitmaps, prefix sums, series, sketches, text."""
