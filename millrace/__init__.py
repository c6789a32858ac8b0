"""Change-feed analytics on Spark: typed changes, routing, mirrors, audits and rollups."""
