"""Review-findings analytics on Spark: DataFrame operators over findings, diffs, edges, votes and runs."""
