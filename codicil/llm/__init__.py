"""Training-data operators: ten jobs over text corpora and their registered queries."""
