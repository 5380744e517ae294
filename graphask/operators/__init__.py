"""DataFrame operators: dictionary, tagging, features, classifiers, graph lookups."""
