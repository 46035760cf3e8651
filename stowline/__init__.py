"""Storage housekeeping and interest-window tick extraction as Spark DataFrame jobs."""
