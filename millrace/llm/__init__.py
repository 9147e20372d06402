"""Training-data operators: filters, joins, search, packing and sharding for text corpora."""
