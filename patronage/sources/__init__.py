from .warehouse import SCHEMAS, Warehouse, normalise, snake_case, write_extract

__all__ = ["SCHEMAS", "Warehouse", "normalise", "snake_case", "write_extract"]
