"""DataFrame operators for text-to-query datasets and triple-shaped graph data."""

__version__ = "0.1.0"
