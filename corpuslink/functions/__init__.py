"""Part of corpuslink."""
