"""Operators of a training-data pipeline. Nothing else in callweave imports this subpackage."""
