"""mediacat: a Spark-native catalogue and deduplication engine for media libraries.

Listings, content hashes, metadata documents, trash feeds, backup listings
and decoder verdicts are DataFrames; every operator returns an outcome
table, an action plan or a new ledger snapshot.
"""

__version__ = "0.1.0"
