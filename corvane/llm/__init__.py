"""Operators for training-data pipelines: term scores, text forms, boilerplate, near duplicates, survivorship, token ids,
mixtures and subjects. Nothing else in the package imports this subpackage."""
