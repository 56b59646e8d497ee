"""Whole plans: generating and executing strategies, and the registered queries."""
