"""Column builders: text metrics, number words, judge parsing, vectors."""
