"""ledgerloom: document reconciliation and audit tests on Spark DataFrames."""
