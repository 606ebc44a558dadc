"""lorekeep: conversation memory and setting retrieval as Spark jobs."""
