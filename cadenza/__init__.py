"""cadenza: session, catalogue and serving analytics written as Spark DataFrame jobs."""
