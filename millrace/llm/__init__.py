"""Operators for building training corpora: packing, filters, joins of near copies, models and file formats."""
