"""Derived inputs and the registered queries built on them."""
