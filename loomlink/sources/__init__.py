from loomlink.sources.tables import table

__all__ = ["table"]
