"""meshweave: mesh and field analytics as ordinary Spark queries."""
