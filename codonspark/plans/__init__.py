"""Registered queries, their SQL, and the stand-in tables they run on."""
