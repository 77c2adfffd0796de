"""pagesearch: saved-link ingest, page extraction, inverted index and ranked
search, written as plain PySpark DataFrame / SQL / Structured Streaming jobs.

Every public function takes DataFrames and returns a DataFrame; nothing is
collected to the driver except bounded size checks.
"""

__version__ = "0.1.0"
