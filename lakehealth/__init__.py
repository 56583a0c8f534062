"""lakehealth: data-lake and warehouse health checks as Spark jobs.

Every check is one set-oriented DataFrame query over all tables at once; the
results are shaped into a single ``findings`` table (severity, location,
indicator, remediation) that is written as a latest snapshot and an appended
history.
"""

__version__ = "0.1.0"
