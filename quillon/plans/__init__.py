"""Catalogued queries over the test tables."""
