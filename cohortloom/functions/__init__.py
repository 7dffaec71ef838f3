"""Column expressions: text keys, laboratory measurements, statistics."""
