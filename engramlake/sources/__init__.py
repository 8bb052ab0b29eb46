from engramlake.sources.tables import table

__all__ = ["table"]
