"""Analytics over feeds of job postings, as Spark transforms."""
