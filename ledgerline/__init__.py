"""ledgerline: deal-flow analytics as Spark DataFrame jobs (see README.md)."""
