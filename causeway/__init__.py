"""causeway: dependency-graph analytics and corpus preparation on Spark."""
