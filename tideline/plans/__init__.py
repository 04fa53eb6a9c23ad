"""Settings, whole cycles, views of tables as postings, and the registered queries."""
