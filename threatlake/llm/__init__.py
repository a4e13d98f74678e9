"""Operators for preparing training data: one module per operator.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries; every operator module documents its results for nulls, empty tables,
very long texts, ties and repeated rows.
"""
