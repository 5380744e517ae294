"""A question-answering workload derived from star-schema tables."""
