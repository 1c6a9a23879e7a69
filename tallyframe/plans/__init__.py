"""Plans: the test-data ledger views and the query catalog."""
