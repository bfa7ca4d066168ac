"""Inputs and predictors made from the document tables, for the registered queries and the tests."""
