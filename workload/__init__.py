"""The registered queries: how they read the test tables, and the same results in SQL."""
