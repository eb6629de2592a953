"""From syntax trees to Spark SQL: query graphs, join ordering and statement planning."""
