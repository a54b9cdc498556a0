"""The registered queries: each a Spark plan and the SQL that says the same."""
