"""Next-activity prediction over process traces as Spark DataFrame jobs."""
