"""callsift: call-transcript analytics as Spark jobs.

Every stage of the pipeline (ingest, dedup, inference, reply validation,
scoring, merge into the keyed store, and the manager-facing reads) is a
DataFrame plan; see README.md for the module map.
"""

__version__ = "0.1.0"
