"""Analytics over token-transfer ledgers as Spark jobs."""
