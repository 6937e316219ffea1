"""Registered queries of the library's own operators, with their SQL, over views that render order data as pricing text."""
