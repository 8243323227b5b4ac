"""tidewater: a Spark-native engine for gating, landing and pulling pushed JSON events.

Every operator takes and returns DataFrames; batch jobs and Structured Streaming
micro-batches share the same functions.
"""

from tidewater.settings import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
