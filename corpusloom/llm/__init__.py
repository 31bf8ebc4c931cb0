"""Training-data operators: classifiers, tokenisation, near-duplicates, rules, sharding, filters."""
