"""The registered queries: fixture views over the driver tables, Spark plans, independent SQL."""
