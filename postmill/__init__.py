"""postmill: job-posting analytics as Spark DataFrame operators.

Stored web pages become posting records, postings are tagged with skills, dated,
deduplicated, kept in a keyed snapshot store and queried - all as DataFrame
expressions, joins and aggregations.
"""
