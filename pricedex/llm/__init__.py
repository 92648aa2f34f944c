"""Training-data operators: filters, deduplication, tokenisation and classifiers over document tables."""
