"""Spark-native analytics for source-code corpora.

``files -> facts -> detections -> evidence -> issues -> report``; every arrow
is a DataFrame transformation.
"""

__version__ = "0.1.0"
