"""Table operators: preparation, encoding, aggregates, windows, joins,
reshaping, scoring, training loops and importance."""
