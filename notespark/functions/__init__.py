"""Column expressions: text clean-up, extraction, predicates and hierarchical keys."""
