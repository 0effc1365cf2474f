"""quantloom: market-factor analytics as DataFrame operators on Spark."""
