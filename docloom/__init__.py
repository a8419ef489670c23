"""Document-structuring analytics on Spark: relational bank, text rewriting, sequence folds, geometry, import and export."""
